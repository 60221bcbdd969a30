"""Word lists, labels and patterns that decide results.

Every rule takes its list as a parameter with one of these as the default, so
a caller extends a rule by passing a longer list.
"""

# --- fixed values: declared domains ---------------------------------------
MATCH_LEVELS = ["高度匹配", "中等匹配", "低度匹配"]
PASS_STATUSES = ["面试通过", "已发offer", "已入职"]
DUPLICATE_FLAG = "重复简历"
ACCEPTED_EXTENSIONS = ["pdf", "doc", "docx"]
MAX_FILE_BYTES = 10 * 1024 * 1024

# --- fixed values: education ------------------------------------------------
EDUCATION_RANK = {
    "博士": 7, "博士后": 7,
    "硕士": 6, "研究生": 6, "MBA": 6, "MPA": 6,
    "本科": 5, "学士": 5,
    "专科": 4, "大专": 4, "高职": 4,
    "高中": 3,
    "职高": 2, "中专": 2,
    "初中": 1,
}
# alias -> level, in lookup order
EDUCATION_ALIASES = {
    "博士": "博士", "博士后": "博士", "phd": "博士", "doctor": "博士",
    "硕士": "硕士", "研究生": "硕士", "master": "硕士", "mba": "硕士",
    "mpa": "硕士", "mpp": "硕士", "msc": "硕士", "ms": "硕士",
    "本科": "本科", "学士": "本科", "学士学位": "本科", "bachelor": "本科",
    "统招本科": "本科", "普通本科": "本科", "大学本科": "本科",
    "专升本": "本科", "全日制本科": "本科",
    "专科": "专科", "大专": "专科", "高等专科": "专科", "college": "专科",
    "associate": "专科", "diploma": "专科", "junior college": "专科",
    "职业学院": "专科", "职业技术学院": "专科",
    "高中": "高中", "普高": "高中", "中学": "高中", "附中": "高中",
    "一中": "高中", "二中": "高中", "三中": "高中", "四中": "高中",
    "中专": "中专", "技校": "中专", "技工": "中专", "职校": "中专",
    "高职": "中专", "technical secondary": "中专", "technical school": "中专",
}
# model answers: first key contained in the answer decides
MODEL_EDUCATION = {
    "博士": "博士", "博士后": "博士",
    "硕士": "硕士", "研究生": "硕士", "MBA": "硕士", "MPA": "硕士",
    "本科": "本科", "学士": "本科",
    "专科": "专科", "大专": "专科", "高职": "专科",
    "高中": "高中", "中专": "中专", "职高": "中专", "初中": "初中",
}
SCHOOL_ENDINGS = ["大学", "学院", "学校", "专科学校", "职业技术学院", "中学",
                  "高中", "中专", "一中", "二中", "三中", "四中", "附中"]
SCHOOL_PREFIXES = ["教育经历", "教育背景", "学历", "毕业院校", "毕业学校",
                   "学校", "院校", "就读", "毕业于", "毕业", "教育"]
SCHOOL_SUFFIXES = ["教育经历", "教育背景", "学历", "毕业", "教育"]
MAJOR_PREFIXES = ["专业", "主修课程", "方向", "主修", "主要课程"]
MAJOR_SUFFIXES = ["专业", "方向", "系", "学院", "专科", "本科", "硕士", "博士"]
MAJOR_DUTY_WORDS = ["分析", "需求", "客户", "家长", "孩子", "负责", "完成"]
MAJOR_DUTY_VERBS = ["管理", "运营", "销售"]
MAJOR_DUTY_OBJECTS = ["客户", "项目", "团队", "公司", "企业", "部门", "工作", "内容", "职责"]

# --- fixed values: key/value labels and section headings --------------------
KEY_TOKENS = [
    "姓名", "性别", "年龄",
    "出生年份", "出生年月", "出生日期",
    "手机", "电话", "联系方式", "联系手机", "手机号", "手机号码", "联系电话",
    "邮箱", "Email", "email", "E-mail",
    "最高学历", "学历",
    "毕业院校", "毕业学校", "学校", "院校",
    "专业",
]
KEY_VALUE_DUTY_WORDS = ["工作内容", "职责", "负责", "完成", "参与"]
PHONE_KEYS = ["手机", "电话", "联系方式", "联系手机", "手机号", "手机号码", "联系电话"]
EMAIL_KEYS = ["邮箱", "Email", "email", "E-mail"]
BIRTH_KEYS = ["出生年份", "出生年月", "出生日期"]
SCHOOL_KEYS = ["毕业院校", "毕业学校", "学校", "院校"]
SECTION_HEADINGS = [
    "基本信息", "个人信息", "求职意向", "个人优势", "自我评价",
    "项目经历", "工作经历", "工作经验", "职业经历", "任职经历",
    "教育经历", "教育背景", "培训经历", "证书", "技能特长",
]
EDUCATION_HEADINGS = ["教育经历", "教育背景", "学历"]
WORK_HEADINGS = ["工作经历", "工作经验", "职业经历", "任职经历", "工作履历"]
WORK_STOPS = ["教育经历", "教育背景", "项目经历", "自我评价", "技能", "证书"]
EDUCATION_STOPS = ["工作经历", "工作经验", "项目经历", "自我评价"]

# --- fixed values: names ----------------------------------------------------
# words beside which a run of characters is a label, not a name
NAME_LABEL_STOPS = ["性别", "年龄", "出生", "籍贯", "民族", "岗位", "运营", "意向"]
CONTACT_WORDS = ["电话", "手机", "邮箱", "email", "联系"]
NOT_A_NAME = [
    "个人", "个人优势", "自我评价", "项目经历", "基本信息",
    "求职意向", "工作经历", "教育经历", "简历", "信息",
    "内容", "业绩", "项目", "岗位", "职位", "工程师",
    "经理", "主管", "老师", "教师", "顾问", "销售", "地址", "邮箱",
    "运营", "客服", "专员", "助播", "设计", "分析师",
]
NAME_STOP_CHARS = "族籍电邮住性学手号龄现"
NAME_CONTEXT_STOPS = ["岗位", "运营", "意向", "城市", "薪资", "类型", "行业", "状态"]

# --- fixed values: companies and positions ----------------------------------
COMPANY_ENDINGS = [
    "公司", "集团", "企业", "科技", "有限公司", "有限责任公司", "股份有限公司",
    "研究院", "研究所", "学校", "大学", "学院", "中心", "事务所", "工作室",
    "银行", "医院", "运营部", "事业部", "馆",
]
COMPANY_SCAN_ENDINGS = [
    "公司", "集团", "企业", "科技", "有限公司", "股份", "银行", "医院", "学院",
    "学校", "中心", "事务所", "工作室", "研究所", "传媒", "网络", "软件",
    "运营部", "事业部", "团队", "艺术馆", "博物馆",
]
COMPANY_STOP_WORDS = ["负责", "主要", "完成", "客户", "加盟", "团队", "目标",
                      "方案", "区域", "需求", "角色", "内容", "工作", "职责"]
COMPANY_PLACEHOLDERS = ["公司名称", "主要负责公司", "主要负责", "负责公司"]
POSITION_WORDS = [
    "主管", "顾问", "经理", "老师", "教师", "工程师", "专员", "主任", "助理",
    "总监", "总裁", "副总", "管理员", "销售", "储备干部", "质量管理", "广告策划",
    "设计师", "分析师", "客服", "行政", "律师",
]
POSITION_LABELS = ["岗位", "职位", "职务", "角色", "任职", "担任", "负责"]
POSITION_DUTY_WORDS = [
    "工作内容", "内容", "间单位", "单位职位", "职责", "负责", "完成", "参与",
    "配合", "业绩", "客户", "项目", "团队", "开发", "维护", "跟进", "一手", "房源",
]
NOT_A_POSITION = ["内容:", "岗位名称", "公司名称", "职位名称", "岗位", "职位",
                  "角色", "人员", "工作", "内容", "职责", "负责", "主要", "完成"]
EXPERIENCE_SKIP_WORDS = ["教育经历", "教育背景", "求职意向", "项目经历"]
SCHOOL_LINE_WORDS = ["大学", "学院", "学校", "中学", "高中"]
DUTY_LINE_WORDS = ["负责", "完成", "参与", "配合", "业绩", "客户", "项目", "团队"]
WORK_YEAR_WORDS = ["工作", "经历", "任职", "项目", "公司", "职业", "岗位",
                   "职位", "职务", "实习", "就业"]
WORK_YEAR_SKIP = ["出生", "生日", "年龄"]
BIRTH_WORDS = ["出生年月", "出生日期", "出生年份", "出生", "生日"]
BIRTH_WORK_WORDS = ["工作", "经历", "经验", "任职", "就职", "入职", "公司", "集团", "企业"]
# the words that rule out a year of 2000 or later although a birth word is near
BIRTH_LATE_WORK_WORDS = ["工作", "经历", "经验", "任职", "就职", "入职"]
# tried in this order; each names a year with what must stand beside it
BIRTH_PATTERNS = [
    r"出生[年月日]*[：:]\s*([0-9]{4})",
    r"生日[：:]\s*([0-9]{4})",
    r"出生[年月日]*[：:]\s*([0-9]{4})[年\-/]",
    r"([0-9]{4})年[0-9]{1,2}月[0-9]{0,2}日?",
    r"([0-9]{4})年",
    r"出生[年月日]*[：:]\s*([0-9]{4})[年月]",
    r"([0-9]{4})[年\-/][0-9]{1,2}[月\-/][0-9]{0,2}",
    r"([0-9]{4})[年\-/][0-9]{1,2}月",
    r"([0-9]{4})[年\-/][0-9]{1,2}",
]
BIRTH_LINE_YEAR = r"(?:出生[年月日]*|生日)\s*[：:]?\s*([0-9]{4})"
WORK_DATE_RANGE = r"[0-9]{4}[./-][0-9]{1,2}[./-]?[0-9]{0,2}\s*[-~至到]+\s*[0-9]{4}"
WORK_YEAR_COMPANY = r"(?:19|20)[0-9]{2}\s+[一-龥]{2,}(?:公司|集团|企业)"
# gender beside an age or a bar
GENDER_LABEL = r"性别\s*[:：]?\s*(男|女)"
GENDER_BEFORE_AGE = r"(男|女)\s*[|｜]\s*[0-9]+\s*岁"
GENDER_CONTEXT = r"(?:男|女)(?:\s*[|｜]|\s+岁|\s+性)"

# --- fixed values: duplicate weights (sum 100) ------------------------------
SIMILARITY_WEIGHTS = {
    "name": 30.0, "phone": 25.0, "email": 20.0, "experience": 15.0,
    "school": 5.0, "major": 3.0, "birth": 2.0,
}
DUPLICATE_THRESHOLD = 80.0
