"""Document files: listing with eligibility, DOCX text, re-extraction."""

from __future__ import annotations

import io
import zipfile
from typing import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from talentgrid import vocab
from talentgrid.functions.basics import blank_to_null
from talentgrid.functions.candidate import file_extension


def eligible(name: Column, length: Column | None = None, max_bytes: int | None = None) -> Column:
    """Accepted extension and, when a bound is given, at most that many bytes."""
    ok = F.coalesce(file_extension(name).isin(vocab.ACCEPTED_EXTENSIONS), F.lit(False))
    return ok if length is None or max_bytes is None else ok & (length <= max_bytes)


def scan_documents(spark: SparkSession, path: str, content: bool = True, max_bytes: int | None = None) -> DataFrame:
    """Files under ``path`` with ``accepted``; rejected files stay in the table.

    ``vocab.MAX_FILE_BYTES`` is the bound that an upload form sets; the scan has none by default.

    Without ``content`` only the listing is read: the bytes column is pruned.
    """
    df = (spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
          .withColumn("accepted", eligible(F.col("path"), F.col("length"), max_bytes)))
    cols = ["path", "modificationTime", "length", "accepted"]
    return df.select(*cols, "content") if content else df.select(*cols)


_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def _paragraph(p: ElementTree.Element) -> str:
    bits = []
    for node in p.iter():
        if node.tag == _W + "t":
            bits.append(node.text or "")
        elif node.tag == _W + "tab":
            bits.append("\t")
        elif node.tag in (_W + "br", _W + "cr"):
            bits.append("\n")
    return "".join(bits).strip()


def _docx_lines(data: bytes) -> list[str]:
    """Header lines, paragraphs, table rows, text boxes, footer lines."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml")).find(_W + "body")
        boxes = [b for b in body.iter(_W + "txbxContent")]
        boxed = [_paragraph(p) for b in boxes for p in b.iter(_W + "p")]
        for parent in list(body.iter()):      # a box must not count as body text too
            for child in list(parent):
                if child.tag == _W + "txbxContent":
                    parent.remove(child)
        lines = [_paragraph(p) for p in body.findall(_W + "p")]
        for row in (r for t in body.findall(_W + "tbl") for r in t.findall(_W + "tr")):
            cells = [" ".join(filter(None, map(_paragraph, c.findall(_W + "p"))))
                     for c in row.findall(_W + "tc")]
            lines.append(" ".join(c for c in cells if c))
        lines += boxed
        for n in sorted(z.namelist()):
            if n.startswith(("word/header", "word/footer")) and n.endswith(".xml"):
                found = [t for t in map(_paragraph, ElementTree.fromstring(z.read(n)).iter(_W + "p"))
                         if len(t) > 1]
                lines = found[::-1] + lines if "header" in n else lines + found
    return [t for t in lines if t]


def _docx_batch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        texts, errors = [], []
        for path, data in zip(pdf["path"], pdf["content"]):
            text, error = None, None
            if data is None:
                pass
            elif str(path).lower().endswith(".doc"):
                error = "不支持旧的 .doc 格式"
            elif str(path).lower().endswith(".pdf"):
                error = "不支持 PDF 格式"
            else:
                try:
                    text = "\n".join(_docx_lines(data)) or None
                    error = None if text else "无法从Word文档中提取文本"
                except Exception as e:  # damaged, encrypted or oddly packed: the file's row says so
                    error = f"Word文档解析失败: {e}"
            texts.append(text)
            errors.append(error)
        yield pd.DataFrame({"path": pdf["path"], "text": texts, "error": errors})


def docx_text(files: DataFrame, rejected: str | None = None) -> DataFrame:
    """``path, text, error`` of Word files; failures are rows, never exceptions.

    Files that are not ``accepted`` are left out, or get ``rejected`` as their error.

    Unzipping has no built-in, so this is one ``mapInPandas`` over the scan's
    own partitions, in small batches.  PDF and old Word files are reported as unsupported.
    """
    content = F.col("content")
    if "accepted" in files.columns:
        files = files if rejected else files.filter("accepted")
        content = F.when(F.col("accepted"), content)
    texts = files.select("path", content.alias("content")).mapInPandas(
        _docx_batch, "path string, text string, error string")
    return texts.withColumn("error", F.coalesce("error", F.when(F.col("text").isNull(), F.lit(rejected))))


def reextract_inputs(resumes: DataFrame, texts: DataFrame) -> DataFrame:
    """``id, text, parse_status, error_message``: stored text, else the file's text.

    ``texts`` is ``path, text, error`` as ``docx_text`` returns it.
    """
    t = texts.select(F.col("path").alias("file_path"), F.struct(
        F.col("text").alias("t"), F.col("error").alias("e")).alias("_f"))
    df = resumes.select("id", "file_path", "raw_text").join(t, "file_path", "left")
    text = F.coalesce(blank_to_null(F.col("raw_text")), blank_to_null(F.col("_f.t")))
    error = (F.when(text.isNotNull(), F.lit(None).cast("string"))
             .when(F.col("_f").isNull(), F.lit("文件不存在"))
             .otherwise(F.coalesce(F.col("_f.e"), F.lit("无法从文件中提取文本"))))
    return df.select("id", text.alias("text"),
                     F.when(text.isNotNull(), "success").otherwise("failed").alias("parse_status"),
                     error.alias("error_message"))


def outcome_counts(df: DataFrame) -> DataFrame:
    """Number of rows by parse status."""
    return df.groupBy("parse_status").agg(F.count(F.lit(1)).alias("n"))
