"""Table schemas as explicit StructTypes."""

from __future__ import annotations

from pyspark.sql import types as T

S, L, I, D, TS = (T.StringType(), T.LongType(), T.IntegerType(),
                  T.DoubleType(), T.TimestampType())

EXPERIENCE = T.StructType([
    T.StructField("company", S), T.StructField("position", S),
    T.StructField("start_year", I), T.StructField("end_year", I),
])
EXPERIENCES = T.ArrayType(EXPERIENCE)
MATCH_ANALYSIS = T.StructType([
    T.StructField("match_score", S), T.StructField("match_level", S),
    T.StructField("detailed_analysis", S),
    T.StructField("strengths", T.ArrayType(S)),
    T.StructField("weaknesses", T.ArrayType(S)),
    T.StructField("suggestions", T.ArrayType(S)),
])
ROUND_ANALYSIS = T.StructType([
    T.StructField("summary", S), T.StructField("strengths", T.ArrayType(S)),
    T.StructField("weaknesses", T.ArrayType(S)), T.StructField("conclusion", S),
    T.StructField("next_questions", T.ArrayType(S)),
])
# what a model may answer; scalars are read as text and checked afterwards
MODEL_ANSWER = ("name string, gender string, birth_year string, phone string, email string, "
                "highest_education string, school string, major string, "
                "work_experience array<struct<company:string,position:string,"
                "start_year:string,end_year:string>>")


def _table(*cols: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in cols])


RESUMES = _table(
    ("id", L), ("file_name", S), ("file_path", S), ("upload_time", TS),
    ("name", S), ("gender", S), ("birth_year", I), ("earliest_work_year", I),
    ("age", I), ("age_from_resume", I), ("phone", S), ("email", S),
    ("highest_education", S), ("school", S), ("school_original", S),
    ("school_code", S), ("school_match_status", S), ("school_confidence", D),
    ("major", S), ("major_original", S), ("major_code", S),
    ("major_match_status", S), ("major_confidence", D),
    ("applied_position", S), ("match_score", I), ("match_level", S),
    ("match_position", S), ("work_experience", EXPERIENCES),
    ("parse_status", S), ("parse_time", TS), ("error_message", S),
    ("duplicate_status", S), ("duplicate_similarity", D),
    ("duplicate_resume_id", L), ("raw_text", S), ("created_by", S),
    ("updated_by", S), ("created_at", TS), ("updated_at", TS),
)
POSITIONS = _table(
    ("id", L), ("position_name", S), ("work_content", S),
    ("job_requirements", S), ("core_requirements", S), ("create_time", TS),
    ("update_time", TS), ("created_by", S), ("updated_by", S),
    ("created_at", TS), ("updated_at", TS),
)
_ROUNDS = [(f"round{k}_{f}", S) for k in (1, 2, 3)
           for f in ("interviewer", "time", "result", "comment", "doc_path",
                     "comment_token", "ai_result")]
REGISTRATION_FIELDS = [
    "fill_date", "contact", "email", "birth_date", "ethnicity",
    "marital_status", "has_children", "origin", "id_card", "first_work_date",
    "recent_work_experience", "education", "hobbies", "current_salary",
    "expected_salary", "available_date", "address_province", "address_city",
    "address_district", "address_detail", "can_travel",
    "consideration_factors", "token", "education_start_date",
    "education_end_date", "institution", "major", "degree", "full_time",
]
INTERVIEWS = _table(
    ("id", L), ("resume_id", L), ("name", S), ("applied_position", S),
    ("identity_code", S), ("match_score", I), ("match_level", S),
    ("status", S), *_ROUNDS, ("round3_enabled", I),
    ("offer_issued", I), ("offer_date", S), ("offer_department", S),
    ("offer_onboard_plan_date", S), ("onboard", I), ("onboard_date", S),
    ("onboard_department", S), ("create_time", TS), ("update_time", TS),
    ("created_by", S), ("updated_by", S), ("created_at", TS),
    ("updated_at", TS), ("analyzed_by", S),
    *[(f"registration_form_{f}", S) for f in REGISTRATION_FIELDS],
)
USERS = _table(("id", L), ("username", S), ("role", S), ("department", S),
               ("group_name", S), ("is_active", I))

TABLES = {"resumes": RESUMES, "positions": POSITIONS,
          "interviews": INTERVIEWS, "users": USERS}
# columns left out of the JSON form of a résumé
RESUME_JSON_OMITS = ["file_path", "school_code", "school_match_status",
                     "school_confidence", "major_code", "major_match_status",
                     "major_confidence"]
