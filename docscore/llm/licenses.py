"""Licence scan: sparse TF-IDF cosine to templates, then inheritance by directory.

DataFrame functions only. Of every text these units are compared with the templates:
its lines and sentences, its blocks (lines up to the next blank one, comment signs
taken away, so that wrapped headers are whole again), the blocks of its comment lines
alone, and the whole text. A unit can only reach the threshold if it has one of a few
heavy template terms, which follows from the weights by Cauchy-Schwarz; others are
passed over. Terms of the rest are counted, joined to the template weights and summed
to cosines. A document without a licence of its own takes that of the licence file in
the nearest directory above it, found by joining directories to their ancestors.
"""

from __future__ import annotations

import math
import re
from collections import Counter

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docscore.llm.license_texts import TEMPLATES, with_files  # noqa: F401
from docscore.llm.storage import Workspace

FILE_NAME = r"(?i)^(licen[sc]e|copying|notice|unlicense)([.-].*)?$"
# what stands between terms
SIGNS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~\t\n\x0b\x0c\r\xa0«»‘’“”„…–—•©"
SEGMENT = r"[\r\n]+|(?<=[.!?;])[ \t]+"
LEADER = r"(?dm)^[ \t]*(?://+[!/]*|/\*+!?|\*+/?|#+|--+|;+|%+|<!--+|--+>|\(\*|\*\)|rem\b|dnl\b)[ \t]*"
NOT_COMMENT = r"(?dm)^(?![ \t]*(?://|/\*|\*|#|--|;|%|<!--|\(\*|rem\b|dnl\b)).*$"
BLOCK = r"(?:[ \t]*\r?\n){2,}[ \t\r\n]*"
THRESHOLD = 0.8
# rounding in sums of doubles
SLACK = 1e-9


def _terms(text: str) -> list[str]:
    return text.lower().translate(str.maketrans(SIGNS, " " * len(SIGNS))).split()


class Weights:
    """Template vectors and the terms without which no segment reaches the threshold."""

    def __init__(self, templates: dict[str, list[str]], df: dict[str, int], n: int, threshold: float):
        self.idf = {t: 1 + math.log((n + 1) / (df.get(t, 0) + 1)) for lines in templates.values() for line in lines for t in _terms(line)}
        self.unknown = 1 + math.log(n + 1)
        self.vectors: list[tuple[str, int, dict[str, float]]] = []
        for licence, lines in templates.items():
            for line in lines:
                tf = Counter(_terms(line))
                norm = math.sqrt(sum((c * self.idf[t]) ** 2 for t, c in tf.items()))
                self.vectors.append((licence, len(self.vectors), {t: c * self.idf[t] / norm for t, c in tf.items()}))
        self.required = _required([v for _, _, v in self.vectors], df, threshold)


def _required(vectors: list[dict[str, float]], df: dict[str, int], threshold: float) -> set[str]:
    """Terms of which every unit that reaches the threshold has one.

    What is left of a template without its required terms bounds its cosine with any unit
    that lacks them. Terms are taken by how much they lower what is too much, in all
    templates, for each document that has them; in the end those that are not needed go,
    the most frequent first.
    """
    most = threshold * threshold - 2 * SLACK
    over = lambda v, taken: sum(w * w for t, w in v.items() if t not in taken) - most
    chosen: set[str] = set()
    while loose := [v for v in vectors if over(v, chosen) >= 0]:
        gain: Counter = Counter()
        for v in loose:
            need = over(v, chosen) + SLACK
            for t, w in v.items():
                if t not in chosen:
                    gain[t] += min(w * w, need)
        chosen.add(max(gain, key=lambda t: (gain[t] / (1 + df.get(t, 0)), t)))
    for t in sorted(chosen, key=lambda t: (-df.get(t, 0), t)):
        if all(over(v, chosen - {t}) < 0 for v in vectors if t in v):
            chosen.remove(t)
    return chosen


def _plain(text: Column) -> Column:
    """The text with a space for every sign between terms."""
    return F.translate(text, SIGNS, " " * len(SIGNS))


def _words(text: Column) -> Column:
    return F.split(_plain(text), " ")


def term_counts(docs: DataFrame, vocabulary: list[str], text_col: str = "text") -> tuple[int, dict[str, int]]:
    """How many documents there are, and how many have each term of the templates."""
    words = _words(F.lower(F.coalesce(F.col(text_col).cast("string"), F.lit(""))))
    found = docs.select(F.explode(F.array_intersect(words, F.array(*map(F.lit, vocabulary)))).alias("term"))
    return docs.count(), {r["term"]: r["n"] for r in found.groupBy("term").agg(F.count("*").alias("n")).collect()}  # bounded by the vocabulary


def units(low: Column, required: set[str]) -> Column:
    """The parts of a lower-cased text to compare, as ``array<struct<kind, said>>`` with only spaces between terms.

    Parts without a required term are left out, and a part equal to one of a smaller
    kind. A text without any is not cut into parts: null.
    """
    heavy = F.array(*map(F.lit, sorted(required)))
    bare = F.regexp_replace(low, LEADER, "")
    comments = F.regexp_replace(F.regexp_replace(low, NOT_COMMENT, ""), LEADER, "")
    kinds = {
        "segment": F.split(bare, SEGMENT),
        "block": F.concat(F.split(bare, BLOCK), F.when(low.rlike(LEADER), F.split(comments, BLOCK)).otherwise(F.array().cast("array<string>"))),
        "file": F.array(bare),
    }
    parts = {}
    for kind, found in kinds.items():
        some = F.transform(found, lambda s: F.trim(F.regexp_replace(_plain(s), " +", " ")))
        parts[kind] = F.filter(some, lambda s: F.arrays_overlap(F.split(s, " "), heavy))
    parts["block"] = F.array_except(parts["block"], parts["segment"])
    parts["file"] = F.array_except(F.array_except(parts["file"], parts["segment"]), parts["block"])

    def tagged(kind: str) -> Column:
        return F.transform(parts[kind], lambda s: F.struct(F.lit(kind).alias("kind"), s.alias("said")))

    return F.when(F.arrays_overlap(_words(low), heavy), F.concat(*map(tagged, parts)))


def _parent(path: Column) -> Column:
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


def _ancestors(folder: Column) -> Column:
    """The folder itself and every folder above it, the root ("") last."""
    parts = F.split(folder, "/")
    above = F.transform(F.sequence(F.size(parts), F.lit(1), F.lit(-1)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    return F.array_distinct(F.concat(above, F.array(F.lit(""))))


def _table(spark: SparkSession, rows: list[tuple], names: list[str]) -> DataFrame:
    """A small table of literals."""
    cells = F.array(*[F.struct(*[F.lit(x).alias(n) for x, n in zip(row, names, strict=True)]) for row in rows])
    return spark.range(1).select(F.explode(cells).alias("r")).select("r.*")


def scan(
    docs: DataFrame,
    path: Column,
    id_col: str = "doc_id",
    text_col: str = "text",
    templates: dict[str, list[str]] | None = None,
    threshold: float = THRESHOLD,
) -> DataFrame:
    """One row per input row: ``doc_id, path, license, basis, cosine, n_matches, inherited_from``.

    ``license`` is that of the matching unit (a cosine of at least ``threshold``) that says
    most: the whole text before a block before a segment, then the largest cosine, then
    the smaller name; ``n_matches`` counts matching units; ``basis`` is ``own``,
    ``inherited`` or ``none``. ``inherited_from`` is the folder of the nearest licence
    file: a document with a licence of its own and a name like LICENSE, COPYING or
    NOTICE, or of which half of the words or more are in matching segments, in matching
    blocks, or in all if the whole text matches. If a folder has several, the largest
    cosine counts, then the smaller name. Null texts are empty and match nothing; a
    null path is at the root. Document frequencies are taken over all rows. Repeated
    rows stay repeated; ids may be of any type; an empty table gives no rows; columns
    of other names are never read.
    """
    work = Workspace(docs.sparkSession, "licenses")
    templates = templates or TEMPLATES
    vocabulary = sorted({t for lines in templates.values() for line in lines for t in _terms(line)})
    n, df = term_counts(docs, vocabulary, text_col)
    weights = Weights(templates, df, n, threshold)
    rows = docs.select(
        F.monotonically_increasing_id().alias("row"),
        F.col(id_col).alias("doc_id"),
        F.coalesce(path, F.lit("")).alias("path"),
        F.lower(F.coalesce(F.col(text_col).cast("string"), F.lit(""))).alias("low"),
    )
    found = rows.withColumn("units", units(F.col("low"), weights.required))
    # numbers depend on how files are split, so the numbered rows are written and never numbered again
    length = F.when(F.size("units") > 0, F.size(F.filter(_words(F.col("low")), lambda w: w != "")))
    rows = work.write(found.select("row", "doc_id", "path", "units", length.alias("length")), "rows")
    terms = (
        rows.select("row", F.posexplode("units").alias("unit", "part"))
        .select("row", "unit", "part.kind", F.explode(F.split("part.said", " ")).alias("term"))
        .groupBy("row", "unit", "kind", "term")
        .agg(F.count("*").alias("tf"))
    )
    spark = docs.sparkSession
    idf = _table(spark, sorted(weights.idf.items()), ["term", "idf"])
    entries = [(name, k, t, w) for name, k, v in weights.vectors for t, w in sorted(v.items())]
    vectors = _table(spark, entries, ["license", "template", "term", "weight"])
    # both tables have a row or a few for each term of the templates
    weighed = terms.join(F.broadcast(idf), "term", "left").withColumn("w", F.col("tf") * F.coalesce("idf", F.lit(weights.unknown)))
    # per unit, the norm and the number of words; of the terms only those of templates
    weighed = work.write(weighed.select("row", "unit", "kind", F.when(F.col("idf").isNotNull(), F.col("term")).alias("term"), "tf", "w"), "terms")
    norms = weighed.groupBy("row", "unit", "kind").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"), F.sum("tf").alias("words"))
    dots = weighed.join(F.broadcast(vectors), "term").groupBy("row", "unit", "template", "license").agg(F.sum(F.col("w") * F.col("weight")).alias("dot"))
    size = F.when(F.col("kind") == "file", 0).when(F.col("kind") == "block", 1).otherwise(2)
    matches = (
        dots.join(norms, ["row", "unit"])
        .withColumn("cosine", F.col("dot") / F.col("norm"))
        .where(F.col("cosine") >= threshold - SLACK)
        .groupBy("row", "unit", "kind")
        .agg(F.min(F.struct(size.alias("size"), (-F.round("cosine", 6)).alias("back"), "license")).alias("best"), F.max("words").alias("words"))
    )
    by_kind = [F.sum(F.when(F.col("kind") == kind, F.col("words")).otherwise(0)) for kind in ("segment", "block", "file")]
    own = matches.groupBy("row").agg(F.min("best").alias("best"), F.count("*").alias("n_matches"), F.greatest(*by_kind).alias("words"))
    own = work.write(own.select("row", "best.license", (-F.col("best.back")).alias("cosine"), "n_matches", "words"), "own")
    placed = rows.select("row", "doc_id", "path", _parent(F.col("path")).alias("folder")).join(own, "row", "left")
    name = F.regexp_extract("path", r"([^/]*)$", 1)
    files = rows.join(own, "row").where(name.rlike(FILE_NAME) | (2 * F.col("words") >= F.col("length")))
    files = files.groupBy(_parent(F.col("path")).alias("above")).agg(F.min(F.struct((-F.col("cosine")).alias("back"), "license")).alias("best"))
    files = work.write(files.select("above", "best.license"), "files")
    folders = placed.where("license IS NULL").select("folder").distinct()
    chain = folders.select("folder", F.posexplode(_ancestors(F.col("folder"))).alias("up", "above"))
    nearest = chain.join(files, "above").groupBy("folder").agg(F.min(F.struct("up", "above", "license")).alias("found"))
    # written, so that Spark splits a folder that a third of all documents are in
    nearest = work.write(nearest.select("folder", F.col("found.license").alias("given"), F.col("found.above").alias("inherited_from")), "nearest")
    return placed.join(nearest.hint("merge"), "folder", "left").select(
        "doc_id",
        "path",
        F.coalesce("license", "given").alias("license"),
        F.when(F.col("license").isNotNull(), "own").when(F.col("given").isNotNull(), "inherited").otherwise("none").alias("basis"),
        F.coalesce("cosine", F.lit(0.0)).alias("cosine"),
        F.coalesce("n_matches", F.lit(0)).cast("long").alias("n_matches"),
        F.when(F.col("license").isNull(), F.col("inherited_from")).alias("inherited_from"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    # the documents have no paths: source and language stand for folders
    path = F.concat_ws("/", F.lit(""), F.coalesce("source", F.lit("unknown")), F.coalesce("lang", F.lit("unknown")), F.col("doc_id").cast("string"))
    return scan(docs, path)
