"""Evaluation: multiset entity scores, error rates, layout scores and their pools."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructType

from .geometry import iou
from .groups import over_groups


def ratio(hit: Column, of: Column) -> Column:
    """hit / of, 1 where there is nothing."""
    return F.when(of == 0, F.lit(1.0)).otherwise(hit / of)


def scores(counts: DataFrame) -> DataFrame:
    """Adds precision, recall and f1 to tp, fp, fn."""
    p, r = ratio(F.col("tp"), F.col("tp") + F.col("fp")), ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    return counts.withColumns({"precision": p, "recall": r}).withColumn("f1", F.when(F.col("precision") + F.col("recall") == 0, F.lit(0.0)).otherwise(2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall"))))


def entity_counts(predicted: DataFrame, reference: DataFrame, kind: str = "entity_type", value: str = "value", within: tuple[str, ...] = ()) -> DataFrame:
    """tp, fp, fn by type of two multisets of (type, value), matched within the given keys."""
    keys = [*within, kind, value]
    p, r = predicted.groupBy(*keys).agg(F.count("*").alias("p")), reference.groupBy(*keys).agg(F.count("*").alias("r"))
    both = p.join(r, keys, "full").select(kind, F.coalesce("p", F.lit(0)).alias("p"), F.coalesce("r", F.lit(0)).alias("r"))
    shared = F.least("p", "r")
    return both.groupBy(kind).agg(F.sum(shared).alias("tp"), F.sum(F.col("p") - shared).alias("fp"), F.sum(F.col("r") - shared).alias("fn"))


def micro(counts: DataFrame, kind: str = "entity_type") -> DataFrame:
    return counts.agg(F.lit("all").alias(kind), *(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("tp", "fp", "fn")))


def entity_diff(predicted: DataFrame, reference: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(missed, spurious): multiset differences both ways."""
    return reference.exceptAll(predicted), predicted.exceptAll(reference)


def mean_or_zero(frame: DataFrame, column: str, name: str) -> DataFrame:
    return frame.agg(F.coalesce(F.avg(column), F.lit(0.0)).alias(name))


def worst(frame: DataFrame, n: int = 5) -> DataFrame:
    """The examples with the highest cer, then entity errors, then layout errors."""
    return frame.orderBy(F.desc("cer"), F.desc("entity_errors"), F.desc("layout_errors"), "id").limit(n)


def box_pairs(predicted: DataFrame, reference: DataFrame, page: str = "page_id", least: float = 0.5) -> DataFrame:
    """Candidate matches with their overlap: boxes of one page whose sides cross."""
    p = predicted.select(page, F.col("idx").alias("p"), F.col("kind").alias("p_kind"), *(F.col(c).alias(f"p{c}") for c in "xywh"))
    r = reference.select(page, F.col("idx").alias("r"), F.col("kind").alias("r_kind"), *(F.col(c).alias(f"r{c}") for c in "xywh"))
    overlap = iou(*(F.col(f"p{c}") for c in "xywh"), *(F.col(f"r{c}") for c in "xywh"))
    touch = (F.col("px") < F.col("rx") + F.col("rw")) & (F.col("rx") < F.col("px") + F.col("pw")) & (F.col("py") < F.col("ry") + F.col("rh")) & (F.col("ry") < F.col("py") + F.col("ph"))
    return p.join(r, page).where(touch).withColumn("iou", overlap).where(F.col("iou") >= least).select(page, "p", "r", "p_kind", "r_kind", "iou")


def _greedy(bounds: list[int], rows: dict[str, list]) -> tuple[list[int], None]:
    keep, p, r = [], rows["p"], rows["r"]
    for first, last in zip(bounds, bounds[1:]):
        used_p, used_r = set(), set()
        for k in range(first, last):
            if p[k] not in used_p and r[k] not in used_r:
                used_p.add(p[k])
                used_r.add(r[k])
                keep.append(k)
    return keep, None


def greedy_matches(pairs: DataFrame, page: str = "page_id") -> DataFrame:
    """One-to-one matches per page: highest overlap first, then reference, then prediction; taken while both are free."""
    rest = [c for c in pairs.columns if c not in (page, "r", "p")]
    columns = [c for c in pairs.columns if c != page]
    schema = StructType([pairs.schema[page], *(pairs.schema[c] for c in columns)])
    order = {"_neg": -F.col("iou"), "r": F.col("r"), "p": F.col("p")}
    return over_groups(pairs, page, order, rest, _greedy, ["p", "r"], columns, schema).select(*pairs.columns)


def layout_score(matches: DataFrame, predicted: DataFrame, reference: DataFrame, page: str = "page_id") -> DataFrame:
    """One row: matches, counts, detection precision and recall, classification accuracy, errors; pooled over pages."""
    m = matches.agg(F.count("*").alias("matched"), F.count(F.when(F.col("p_kind") == F.col("r_kind"), 1)).alias("right")).withColumn("one", F.lit(1))
    p = predicted.agg(F.count("*").alias("predicted")).withColumn("one", F.lit(1))
    r = reference.agg(F.count("*").alias("reference")).withColumn("one", F.lit(1))
    x = m.join(p, "one").join(r, "one").drop("one")
    errors = (F.col("reference") - F.col("matched")) + (F.col("predicted") - F.col("matched")) + (F.col("matched") - F.col("right"))
    return x.withColumns({
        "precision": ratio(F.col("matched"), F.col("predicted")), "recall": ratio(F.col("matched"), F.col("reference")),
        "accuracy": ratio(F.col("right"), F.col("matched")), "error_count": errors,
    })


def layout_by_type(matches: DataFrame, predicted: DataFrame, reference: DataFrame, page: str = "page_id") -> DataFrame:
    """tp, fp, fn by type; a match of two types misses the reference's and adds to the predicted one's."""
    same = F.col("p_kind") == F.col("r_kind")
    tag = lambda f, c, k: f.select(F.col(c).alias("kind"), F.lit(k).alias("tag"))
    rows = tag(matches.where(same), "r_kind", "tp").union(tag(matches.where(~same), "r_kind", "fn")).union(tag(matches.where(~same), "p_kind", "fp"))
    rows = rows.union(tag(reference.join(matches.select(page, F.col("r").alias("idx")), [page, "idx"], "left_anti"), "kind", "fn"))
    rows = rows.union(tag(predicted.join(matches.select(page, F.col("p").alias("idx")), [page, "idx"], "left_anti"), "kind", "fp"))
    return rows.groupBy("kind").agg(*(F.count(F.when(F.col("tag") == t, 1)).alias(t) for t in ("tp", "fp", "fn")))


def confusion(matches: DataFrame) -> DataFrame:
    return matches.groupBy("r_kind", "p_kind").agg(F.count("*").cast("long").alias("n"))


def confusion_table(matches: DataFrame, kinds: list[str]) -> DataFrame:
    return matches.groupBy("r_kind").pivot("p_kind", kinds).agg(F.count("*"))


def indel_similarity(a: str, b: str) -> float:
    """2 * longest common subsequence / both lengths; 1 for two empty strings. Bit-parallel over Python integers."""
    if not a or not b:
        return 1.0 if not a and not b else 0.0
    where: dict[str, int] = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << i
    mask = (1 << len(a)) - 1
    s = mask
    for c in b:
        u = s & where.get(c, 0)
        s = ((s + u) | (s - u)) & mask
    return 2 * (len(a) - s.bit_count()) / (len(a) + len(b))


@F.pandas_udf(DoubleType())
def indel(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([indel_similarity(x or "", y or "") for x, y in zip(a, b, strict=True)], dtype=float)


def markdown(title: str, frames: dict[str, DataFrame]) -> Iterator[str]:
    """Lines of a report: a heading and a table for each (small, aggregated) frame."""
    yield f"# {title}"
    for name, frame in frames.items():
        yield f"\n## {name}\n"
        yield "| " + " | ".join(frame.columns) + " |"
        yield "|" + "---|" * len(frame.columns)
        for row in frame.limit(1_000).collect():
            yield "| " + " | ".join("" if v is None else f"{v:.4f}" if isinstance(v, float) else str(v) for v in row) + " |"
