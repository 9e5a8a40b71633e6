"""Chunking of Markdown documents in column functions: token estimate, sections, greedy merge, oversize split, titles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TARGET, LARGEST, OVERLAP = 400, 500, 50
CJK = "[가-힣一-鿿぀-ヿ]"
DOC_TYPES = {"incident_report": "장애보고", "technical_doc": "기술문서", "meeting_note": "회의록", "proposal": "제안서"}
BREAK = "\n\n"


def stripped(text: Column) -> Column:
    """Without Unicode white space at both ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def lines(text: Column) -> Column:
    """Every kind of line end as a line feed."""
    return F.regexp_replace(text, "\r\n|[\r\u000b\u000c\u001c-\u001e\u0085  ]", "\n")


def tokens(text: Column) -> Column:
    """One for a CJK character, 1.3 for a run of ASCII letters and digits, cut to a whole number."""
    return F.floor(F.regexp_count(text, F.lit(CJK)) + F.regexp_count(text, F.lit("[A-Za-z0-9]+")) * F.lit(1.3)).cast("int")


def sections(text: Column) -> Column:
    """Cut before lines of two or three # and a blank; empty sections are dropped."""
    parts = F.split(lines(text), r"(?m)(?=^#{2,3}[^\S\n])")
    return F.filter(F.transform(parts, stripped), lambda s: s != "")


def merged(parts: Column, target: int = TARGET, glue: str = BREAK) -> Column:
    """Neighbouring parts joined as long as their tokens stay within the target; a larger part stands alone."""
    kind = "struct<out:array<string>,held:array<string>,n:int>"
    start = F.struct(F.array().cast("array<string>").alias("out"), F.array().cast("array<string>").alias("held"), F.lit(0).alias("n")).cast(kind)

    def step(s: Column, x: Column) -> Column:
        n = tokens(x)
        full = (F.size(s["held"]) > 0) & (s["n"] + n > target)
        return F.struct(
            F.when(full, F.concat(s["out"], F.array(F.array_join(s["held"], glue)))).otherwise(s["out"]).alias("out"),
            F.when(full, F.array(x)).otherwise(F.concat(s["held"], F.array(x))).alias("held"),
            F.when(full, n).otherwise(s["n"] + n).cast("int").alias("n"),
        ).cast(kind)

    return F.aggregate(parts, start, step, lambda s: F.when(F.size(s["held"]) > 0, F.concat(s["out"], F.array(F.array_join(s["held"], glue)))).otherwise(s["out"]))


def _tail(held: Column) -> Column:
    """The last paragraphs that reach the overlap together, one at least."""
    kind = "struct<kept:array<string>,n:int>"
    start = F.struct(F.array().cast("array<string>").alias("kept"), F.lit(0).alias("n")).cast(kind)
    return F.aggregate(F.reverse(held), start, lambda s, x: F.when(s["n"] >= OVERLAP, s).otherwise(F.struct(F.concat(F.array(x), s["kept"]).alias("kept"), (s["n"] + tokens(x)).cast("int").alias("n")).cast(kind)), lambda s: s["kept"])


def split_oversize(text: Column) -> Column:
    """A text of more than the largest size cut at blank lines; each part starts with the end of the one before it."""
    kind = "struct<out:array<string>,held:array<string>,n:int>"
    empty = F.array().cast("array<string>")
    paragraphs = F.filter(F.transform(F.split(text, r"\n\s*\n"), stripped), lambda p: p != "")
    count = lambda held: F.aggregate(held, F.lit(0), lambda s, x: s + tokens(x))

    def step(s: Column, x: Column) -> Column:
        n = tokens(x)
        full = (F.size(s["held"]) > 0) & (s["n"] + n > LARGEST)
        tail = _tail(s["held"])
        return F.struct(
            F.when(full, F.concat(s["out"], F.array(F.array_join(s["held"], BREAK)))).otherwise(s["out"]).alias("out"),
            F.when(full, F.concat(tail, F.array(x))).otherwise(F.concat(s["held"], F.array(x))).alias("held"),
            F.when(full, count(tail) + n).otherwise(s["n"] + n).cast("int").alias("n"),
        ).cast(kind)

    parts = F.aggregate(paragraphs, F.struct(empty.alias("out"), empty.alias("held"), F.lit(0).alias("n")).cast(kind), step, lambda s: F.when(F.size(s["held"]) > 0, F.concat(s["out"], F.array(F.array_join(s["held"], BREAK)))).otherwise(s["out"]))
    return F.when(tokens(text) > LARGEST, parts).otherwise(F.array(text))


def doc_type(raw: Column) -> Column:
    """The label of a document type; an unknown type is an error."""
    found = F.create_map(*[F.lit(x) for kv in DOC_TYPES.items() for x in kv])[raw]
    return F.when(found.isNotNull(), found).otherwise(F.raise_error(F.concat(F.lit("unknown document type "), F.coalesce(raw, F.lit("null")))))


def titled(title: Column, piece: Column) -> Column:
    return F.when(piece.startswith("# "), piece).otherwise(F.concat(F.lit("# "), title, F.lit(BREAK), piece))


def chunks(documents: DataFrame) -> DataFrame:
    """doc_id, chunk_index, content, metadata of documents (ord, id, title, type, filename, body)."""
    pieces = F.flatten(F.transform(merged(sections(F.col("body"))), split_oversize))
    rows = documents.select("ord", "id", "title", "type", "filename", F.posexplode(pieces).alias("chunk_index", "piece"))
    meta = F.struct(F.col("id").alias("doc_id"), F.col("title").alias("doc_title"), doc_type(F.col("type")).alias("doc_type"), F.col("type").alias("doc_type_raw"), "chunk_index", F.concat(F.lit("documents/"), "filename").alias("source_path"))
    return rows.select("ord", F.col("id").alias("doc_id"), "chunk_index", titled(F.col("title"), F.col("piece")).alias("content"), meta.alias("metadata"))


def chunk_statistics(made: DataFrame) -> DataFrame:
    """doc_id, n_chunks, mean_tokens (cut to a whole number), max_tokens of chunks (doc_id, content)."""
    n = made.withColumn("n", tokens(F.col("content")))
    return n.groupBy("doc_id").agg(F.count("*").alias("n_chunks"), F.expr("sum(n) div count(*)").alias("mean_tokens"), F.max("n").cast("long").alias("max_tokens"))
