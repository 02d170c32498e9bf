"""Line dedup by a tree of templates: lines that differ in variable fields alone are one template.

The tree has a fixed depth: lines part by the number of their tokens, then by their leading
tokens, where a token with a digit counts as variable. In a leaf, a token is constant at its place
if enough documents have it there; any other token is a variable field. A line's template is its
leaf and its constant tokens. A line of which more than half is fields has no template: it recurs
only where the whole line is equal. Everything is made of DataFrame operations.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, written

#: A character of a token; a token with an ASCII digit among tokens with one space between; and what stands for it.
TOKEN = r"[^\x20\x09-\x0D]"
VARIABLE = r"(^| )[^ 0-9]*+[0-9][^ ]*+"
FIELD = "<*>"
#: Leaves that are broadcast at most; more of them are joined by a shuffle.
BROADCAST_KEYS = 1_000_000


@dataclass(frozen=True)
class Tree:
    """``depth`` leading tokens; a template is one that ``documents`` documents have and of whose words ``percent`` percent are constant.

    A word is constant at its place if ``share`` percent of the documents of its leaf have it there, and ``documents`` at least;
    so what is a variable field does not change with the size of the corpus.
    """

    depth: int = 3
    documents: int = 3
    percent: int = 75
    share: int = 10


def _plain(line: Column) -> Column:
    """The tokens of a line with one space between."""
    return F.regexp_replace(F.btrim(line, F.lit(" \t\r\x0b\x0c")), f"{SPACE}+", " ")


def _masked(plain: Column) -> Column:
    """Tokens with an ASCII digit become field marks."""
    return F.when(plain.rlike("[0-9]"), F.regexp_replace(plain, VARIABLE, f"$1{FIELD}")).otherwise(plain)


def _size(tokens: Column) -> Column:
    return F.size(F.split(tokens, " "))


def _words(tokens: Column) -> Column:
    """How many of the masked tokens are no field marks."""
    return _size(tokens) - F.regexp_count(tokens, F.lit(r"(?<![^ ])<\*>(?![^ ])"))


def _mostly_fields(tokens: Column) -> Column:
    return 2 * _words(tokens) < _size(tokens)


def _leaf(line: Column, tree: Tree) -> Column:
    """Hash of the number of tokens and the leading ones; the rest of the line is only counted."""
    leading = F.regexp_extract(line, f"^{SPACE}*+((?:{TOKEN}++{SPACE}*+){{0,{tree.depth}}})", 1)
    return F.xxhash64(F.regexp_count(line, F.lit(f"{TOKEN}++")), _masked(_plain(leading)))


def _lines(docs: DataFrame, tree: Tree, key: str, text: str) -> DataFrame:
    """A row per line: key, content, line number, the line and its leaf."""
    lines = docs.select(F.col(key).alias("key"), F.xxhash64(F.col(text)).alias("content"), F.posexplode(F.split(F.col(text), "\n", -1)).alias("line", "raw"))
    return lines.select("key", "content", "line", "raw", _leaf(F.col("raw"), tree).alias("leaf"))


def _documents_per(rows: DataFrame, by: list[str]) -> DataFrame:
    """``by`` and the number of different documents, summed up before and after the first shuffle."""
    return rows.select(*by, "key", "content").distinct().groupBy(*by).agg(F.count("*").alias("documents"))


def recurring_lines(docs: DataFrame, tree: Tree = Tree(), key: str = "doc_id", text: str = "text") -> DataFrame:
    """Occurrences (``key``, ``content``, ``line``) of recurring templates, with ``leaf``, ``template`` and whether the document comes first.

    First the leaves that enough documents reach are found from hashes; only lines in those go on
    with their tokens. The first document of a template has the smallest key (null first), then
    the smallest text hash. A null text has no lines, an empty table none either; long lines are lines like others.
    """
    every = _lines(docs, tree, key, text)
    leaves = written(_documents_per(every, ["leaf"]).where(F.col("documents") >= tree.documents).withColumnRenamed("documents", "_in_leaf"), "leaves")
    leaves = leaves.where(F.col("leaf") != _leaf(F.lit(""), tree))
    known = F.broadcast(leaves) if leaves.count() <= BROADCAST_KEYS else leaves
    # Whole lines are masked in those leaves alone.
    plain = _plain(F.col("raw"))
    lines = every.join(known, "leaf").select("key", "content", "line", "leaf", "_in_leaf", _masked(plain).alias("tokens"), plain.alias("_plain"))
    shape = F.when(_mostly_fields(F.col("tokens")), F.xxhash64(F.lit(FIELD), "_plain")).otherwise(F.xxhash64("tokens"))
    lines = written(lines.withColumn("shape", shape).drop("_plain"), "lines")

    shapes = lines.groupBy("leaf", "shape").agg(F.max("tokens").alias("tokens"), F.max("_in_leaf").alias("_in_leaf"))
    shapes = written(shapes.join(_documents_per(lines, ["leaf", "shape"]), ["leaf", "shape"]), "shapes")
    worded = shapes.where(~_mostly_fields(F.col("tokens")))
    deep = worded.select("leaf", "shape", "documents", "_in_leaf", F.posexplode(F.split("tokens", " ")).alias("at", "token")).where((F.col("at") >= tree.depth) & (F.col("token") != FIELD))
    often = (F.col("_n") >= tree.documents) & (100 * F.col("_n") >= tree.share * F.col("_in_leaf"))
    constant = deep.groupBy("leaf", "at", "token").agg(F.sum("documents").alias("_n"), F.max("_in_leaf").alias("_in_leaf")).where(often)
    constant = constant.select("leaf", "at", "token", F.lit(True).alias("_constant"))
    # Order-free hash of the constant words and their places.
    word = F.when(F.col("_constant"), F.xxhash64("at", "token"))
    kept = deep.join(constant, ["leaf", "at", "token"], "left").groupBy("leaf", "shape").agg(F.coalesce(F.bit_xor(word), F.lit(0)).alias("template"), F.count("_constant").alias("_constants"))
    lead = _words(F.array_join(F.slice(F.split("tokens", " "), 1, tree.depth), " "))
    held = F.col("_lead") + F.coalesce("_constants", F.lit(0))
    templates = shapes.select("leaf", "shape", _words(F.col("tokens")).alias("_words"), lead.alias("_lead"), _mostly_fields(F.col("tokens")).alias("_equal")).join(kept, ["leaf", "shape"], "left").where(
        F.col("_equal") | (held * 100 >= F.col("_words") * tree.percent)
    ).select("leaf", "shape", F.when(F.col("_equal"), F.col("shape")).otherwise(F.coalesce("template", F.lit(0))).alias("template"))
    found = lines.select("key", "content", "line", "leaf", "shape").join(templates.select("leaf", "shape", "template"), ["leaf", "shape"])
    found = written(found.select("key", "content", "line", "leaf", "template"), "template-lines")
    document = F.struct("key", "content")
    wide = found.select("leaf", "template", "key", "content").distinct().groupBy("leaf", "template").agg(F.count("*").alias("documents"), F.min(document).alias("_first"))
    wide = wide.where(F.col("documents") >= tree.documents)
    return found.join(wide, ["leaf", "template"]).select("key", "content", "line", "leaf", "template", "documents", document.eqNullSafe(F.col("_first")).alias("first"))


def drop_recurring_lines(docs: DataFrame, tree: Tree = Tree(), key: str = "doc_id", text: str = "text", length: str = "n_chars", counts: bool = False) -> DataFrame:
    """``docs`` with all columns, recurring lines gone from ``text`` in all documents but the first that has them.

    ``length``, where it is a column, is counted anew for changed texts. With ``counts``, columns
    ``n_lines`` and ``n_dropped`` come last, in place of such columns of ``docs``. Rows never go: a document that loses every line keeps
    an empty text. Lines without a token stay; a null text stays null with no lines; rows equal
    in key and text are one document and change alike; other rows with one key stand for
    themselves. An empty table gives no rows.
    """
    gone = recurring_lines(docs, tree, key, text).where("NOT first").groupBy("key", "content").agg(F.collect_set("line").alias("_gone"))
    gone = gone.select(F.col("key").alias("_key"), F.col("content").alias("_content"), "_gone")
    whole = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("_doc"), F.xxhash64(docs[text]).alias("_hash"), F.split(docs[text], "\n", -1).alias("_lines"))
    joined = whole.join(gone, whole["_doc"][key].eqNullSafe(gone["_key"]) & (whole["_hash"] == gone["_content"]), "left")
    left = F.array_except(F.sequence(F.lit(0), F.size("_lines") - 1), "_gone")
    changed = F.col("_gone").isNotNull()
    new = F.when(changed, F.array_join(F.transform(left, lambda i: F.get(F.col("_lines"), i)), "\n")).otherwise(F.col(f"_doc.`{text}`"))
    joined = joined.withColumn("_new", new)

    def column(name: str) -> Column:
        if name == text:
            return F.col("_new").alias(text)
        old = F.col(f"_doc.`{name}`")
        if name == length:
            return F.when(changed, F.char_length("_new").cast(docs.schema[name].dataType)).otherwise(old).alias(name)
        return old.alias(name)

    taken = {"n_lines", "n_dropped"} if counts else set()
    extra = [F.when(F.col("_lines").isNull(), 0).otherwise(F.size("_lines")).cast("bigint").alias("n_lines"), F.coalesce(F.size("_gone"), F.lit(0)).cast("bigint").alias("n_dropped")]
    return joined.select(*[column(c) for c in docs.columns if c not in taken], *(extra if counts else []))
