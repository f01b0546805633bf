"""Review, curation and batch control: merging decisions, guarding batches, summaries beside them."""

from __future__ import annotations

import json
import re
import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from kilnwork.functions import text as X

#: Names of metadata fields that stand for others (fixed values).
ALIASES = {"colour": "color", "ware type": "ware", "diam": "diameter", "rim diameter": "diameter", "nonplastics": "inclusions", "temper": "inclusions"}


def ensure_columns(df: DataFrame, names: list[str]) -> DataFrame:
    """``df`` with blank columns for names that it lacks."""
    return df.withColumns({n: F.lit("") for n in names if n not in df.columns}) if set(names) - set(df.columns) else df


def canonical_field(c: Column) -> Column:
    key = F.lower(F.trim(c))
    return F.coalesce(F.create_map(*[F.lit(x) for kv in ALIASES.items() for x in kv])[key], key)


def first_pages(pages: DataFrame, figure: str, page: str) -> DataFrame:
    """The first page on which each figure's heading stands."""
    return pages.where(F.coalesce(figure, F.lit("")) != "").groupBy(figure).agg(F.min(page).alias(page))


def classified(cards: DataFrame, classes: DataFrame, file: str, value: str, default: str) -> DataFrame:
    """Cards with their class by file name without image extension, or the default. Of several classes the smallest."""
    known = classes.groupBy(X.card_stem(F.col(file)).alias("_stem")).agg(F.min(value).alias(value))
    return cards.withColumn("_stem", X.card_stem(F.col(file))).join(known, "_stem", "left").withColumn(value, F.coalesce(value, F.lit(default))).drop("_stem")


def box_counts(images: DataFrame, boxes: DataFrame, polygons: DataFrame, image: str = "image") -> DataFrame:
    """Boxes that aren't deleted for each image; polygons for an image without any box."""
    b = boxes.groupBy(image).agg(F.count_if(F.col("status") != "deleted").alias("_boxes"))
    p = polygons.groupBy(image).agg(F.count(F.lit(1)).alias("_polygons"))
    return images.select(image).join(b, image, "left").join(p, image, "left").select(image, F.coalesce("_boxes", "_polygons", F.lit(0)).cast("long").alias("n_boxes"))


def foreign_sources(drawings: DataFrame, rows: DataFrame, figure: str, source: str) -> DataFrame:
    """(figure, sources): sources of a figure's rows that none of its drawings has; figures with such sources only."""
    a = drawings.groupBy(figure).agg(F.collect_set(source).alias("_own"))
    b = rows.groupBy(figure).agg(F.collect_set(source).alias("_rows"))
    out = b.join(a, figure, "left").select(figure, F.array_sort(F.array_except("_rows", F.coalesce("_own", F.array().cast("array<string>")))).alias("sources"))
    return out.where(F.size("sources") > 0)


def reset_changed(before: DataFrame, after: DataFrame, key: str, box: str, columns: dict[str, str]) -> DataFrame:
    """``after`` with review columns set back to a value where the box changed or is new."""
    old = before.select(key, F.col(box).alias("_was"), F.lit(True).alias("_there"))
    joined = after.join(old, key, "left")
    same = F.coalesce(F.col("_there"), F.lit(False)) & F.col(box).eqNullSafe(F.col("_was"))
    return joined.withColumns({c: F.when(same, F.col(c)).otherwise(F.lit(v)) for c, v in columns.items()}).drop("_was", "_there")


def apply_review(stored: DataFrame, submitted: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Stored boxes with what a reviewer submitted: identities are the stored ones, what isn't submitted stays, a
    deletion is a status, and submitted keys that aren't stored are new."""
    new = submitted.select(key, *[F.col(c).alias(f"_new_{c}") for c in columns], F.lit(True).alias("_given"))
    return stored.join(new, key, "full").select(key, *[F.when(F.col("_given"), F.col(f"_new_{c}")).otherwise(F.col(c)).alias(c) for c in columns])


def merge_manifest(prior: DataFrame, wanted: DataFrame, key: str, reuse: list[str], decision: str) -> DataFrame:
    """Wanted entries with the prior decision; ``render`` where any of the facts differs or there is no prior entry. Prior entries that aren't wanted stay."""
    old = prior.select(key, F.col(decision).alias("_decision"), *[F.col(c).alias(f"_was_{c}") for c in reuse], F.lit(True).alias("_old"))
    same = F.coalesce(F.col("_old"), F.lit(False))
    for c in reuse:
        same = same & F.col(c).eqNullSafe(F.col(f"_was_{c}"))
    kept = prior.join(wanted.select(key), key, "left_anti").select(key, *reuse, decision, F.lit(False).alias("render"))
    return wanted.join(old, key, "left").select(key, *reuse, F.coalesce("_decision", F.lit("pending")).alias(decision), (~same).alias("render")).unionByName(kept)


def batch_faults(results: DataFrame, expected: DataFrame, key: str, version: str, pool: str, pool_size: int) -> DataFrame:
    """(key, fault): missing, unexpected, repeated, other_version (than the commonest, the smallest of equals) and short_pool."""
    n = results.groupBy(key).agg(F.count(F.lit(1)).alias("_n"), F.min(version).alias("_v"), F.min(pool).alias("_p"))
    usual = results.groupBy(version).agg(F.count(F.lit(1)).alias("_c")).agg(F.min_by(version, F.struct(-F.col("_c"), version)).alias("_usual"))
    both = n.join(expected.select(key, F.lit(True).alias("_wanted")), key, "full").join(F.broadcast(usual))
    fault = lambda when, name: F.when(when, F.lit(name))
    found = F.array_compact(F.array(fault(F.col("_n").isNull(), "missing"), fault(F.col("_wanted").isNull(), "unexpected"), fault(F.col("_n") > 1, "repeated"), fault(F.col("_v") != F.col("_usual"), "other_version"), fault(F.col("_p") < pool_size, "short_pool")))
    return both.select(key, F.explode(found).alias("fault"))


def beside_expected(scores: DataFrame, known: DataFrame, by: str, id_: str, score: str) -> DataFrame:
    """Each query's two lowest scores and its known answer, each once, with place (null for a known answer beyond the two)."""
    two = scores.withColumn("place", F.row_number().over(W.partitionBy(by).orderBy(score, id_))).where("place <= 2").select(by, id_, score, "place")
    answer = known.select(by, id_).join(scores.select(by, id_, score), [by, id_]).withColumn("place", F.lit(None).cast("int"))
    return two.unionByName(answer.join(two.select(by, id_), [by, id_], "left_anti"))


def letters_back(cards: DataFrame, values: DataFrame, group: str, order: str, card: str, letter: str = "letter") -> DataFrame:
    """Values named by letters (A is a group's first card, and so on) with their cards."""
    at = cards.withColumn(letter, F.chr(F.lit(64) + F.row_number().over(W.partitionBy(group).orderBy(order)))).select(group, letter, card)
    return values.join(at, [group, letter])


def citation_index(rows: DataFrame, figure: str, item: str, fields: list[str]) -> DataFrame:
    """(figure digits, first item number, lists): what each citation's rows say, blanks left out, sorted."""
    keyed = rows.select(F.regexp_replace(figure, r"\D", "").alias("figure"), F.regexp_extract(item, r"(\d+)", 1).try_cast("long").alias("item"), *[F.when(F.trim(F.coalesce(f, F.lit(""))) != "", F.trim(f)).alias(f) for f in fields])
    return keyed.groupBy("figure", "item").agg(*[F.array_sort(F.collect_set(f)).alias(f) for f in fields])


def rank_change(a: DataFrame, b: DataFrame, by: list[str], id_: str, rank: str = "rank") -> DataFrame:
    """How many places each row moved up from a to b."""
    return a.select(*by, id_, F.col(rank).alias("_a")).join(b.select(*by, id_, F.col(rank).alias("_b")), [*by, id_]).select(*by, id_, (F.col("_a") - F.col("_b")).cast("long").alias("moved"))


def best_hypotheses(df: DataFrame, by: list[str], facts: dict[str, float], score: str, id_: str) -> DataFrame:
    """The lowest score among rows whose facts agree when rounded to the given steps."""
    steps = [F.round(F.col(c) / s).cast("long").alias(f"_{c}") for c, s in facts.items()]
    best = df.select(*by, *steps, F.struct(score, id_).alias("_b")).groupBy(*by, *[f"_{c}" for c in facts]).agg(F.min("_b").alias("_b"))
    return best.select(*by, f"_b.{score}", f"_b.{id_}")


def row_order(rows: DataFrame, pages: DataFrame, figure: str, number: str, page: str, index: str) -> DataFrame:
    """Rows of a figure with ``place``: blank numbers last, natural number, page rank (unknown pages last), first index."""
    rank = F.row_number().over(W.partitionBy(figure).orderBy(F.coalesce("logical_index", F.lit(10**9)), X.natural_key(F.col(page))))
    placed = pages.select(figure, page, rank.alias("_rank"))
    n = F.col(number)
    order = [X.is_positive_number(n).cast("int").alias("x").desc(), X.natural_key(n), F.coalesce("_rank", F.lit(10**9)), F.col(index)]
    out = rows.join(placed, [figure, page], "left").withColumn("place", F.row_number().over(W.partitionBy(figure).orderBy(*order)).cast("long"))
    return out.drop("_rank")


def metric_summary(df: DataFrame, method: str, metrics: list[str]) -> DataFrame:
    """(method, metric, mean, median, std): population deviations, missing values left out."""
    long = df.unpivot([method], metrics, "metric", "value").where("value is not null")
    return long.groupBy(method, "metric").agg(F.avg("value").alias("mean"), F.percentile("value", 0.5).alias("median"), F.stddev_pop("value").alias("std"))


def migrated(states: DataFrame, diagnostics: str, key: str) -> tuple[DataFrame, DataFrame]:
    """Versioned state without its diagnostics, and the diagnostics as a table of their own by key."""
    side = states.where(F.col(diagnostics).isNotNull()).select(key, F.explode(diagnostics).alias("d")).select(key, "d.*")
    return states.drop(diagnostics).withColumn("version", F.lit(2)), side


def explanations(field: Column, compat: Column, a: Column, b: Column) -> Column:
    """A line about one compared field."""
    grade = F.when(compat >= 0.90, "close").when(compat >= 0.65, "compatible").otherwise("different")
    return F.format_string("%s: %s / %s (%s, %.2f)", field, a, b, grade, compat)


def _loaded(text: str) -> str | None:
    """The value in compact form, with commas before a closing bracket dropped if need be; None if it is none."""
    for tried in (text, re.sub(r",\s*([}\]])", r"\1", text)):
        try:
            return json.dumps(json.loads(tried), ensure_ascii=False)
        except ValueError:
            continue
    return None


def _repaired(text: str | None) -> str | None:
    t = (text or "").strip()
    if t.startswith("```"):
        t = re.sub(r"\n?```\s*$", "", re.sub(r"^```[a-zA-Z]*\n?", "", t)).strip()
    t = t.translate({0x201C: '"', 0x201D: '"', 0x2019: "'"})
    begin = t.find("{")
    if begin < 0:
        return None
    t = t[begin:]
    # Brackets that are open at each place where one closes; a cut answer ends at the last of them.
    open_: list[str] = []
    last: tuple[int, list[str]] | None = None
    quoted = escaped = False
    for i, c in enumerate(t):
        if quoted:
            quoted, escaped = c != '"' or escaped, c == "\\" and not escaped
        elif c == '"':
            quoted = True
        elif c in "{[":
            open_.append("}" if c == "{" else "]")
        elif c in "}]":
            if open_ and open_[-1] == c:
                open_.pop()
            last = i + 1, open_.copy()
            if not open_:
                break
    if last is None:
        return None
    whole = _loaded(t[: last[0]]) if not last[1] else _loaded(t)
    return whole or _loaded(t[: last[0]] + "".join(reversed(last[1])))


@F.pandas_udf(StringType())
def repaired_json(texts: pd.Series) -> pd.Series:
    """The first JSON object of a model's answer: fences and curly quotes removed, trailing commas dropped, a cut answer up to its last whole part; null without one."""
    return texts.map(_repaired)


@F.pandas_udf(StringType())
def printable_ascii(texts: pd.Series) -> pd.Series:
    """Compatibility forms (NFKC), then printable ASCII, line breaks and tabs only, trimmed; null is empty."""
    return texts.map(lambda t: "".join(c for c in unicodedata.normalize("NFKC", t or "") if " " <= c <= "~" or c in "\n\t").strip())


#: Headings of the expected table (fixed values): needed ones, main ones and those of the second line.
NEEDED_HEADINGS = [r"\bno\b", r"\btype\b"]
MAIN_HEADINGS = [r"\bsq\b", r"\bloc\b", r"\bpail\b", r"\breg\b", r"fabric\s+color", r"non\s+plastics", r"\bvoids?\b", r"\bman\b", r"surface\s+treatment", r"\bdecor\b", r"\bfire\b"]
SUB_HEADINGS = [r"\bexterior\b", r"\bcore\b", r"\binterior\b", r"\btyp\b", r"\bsiz\b", r"\bshap\b", r"\bden\b", r"ty\s*sz", r"\bext\b", r"\bint\b"]


def header_expected(c: Column) -> Column:
    """Whether a header has the needed headings, four main ones and two of the second line."""
    t = F.trim(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"[^a-z0-9]+", " "))
    n = lambda ps: sum((t.rlike(p).cast("int") for p in ps), F.lit(0))
    return (n(NEEDED_HEADINGS) == len(NEEDED_HEADINGS)) & (n(MAIN_HEADINGS) >= 4) & (n(SUB_HEADINGS) >= 2)


def siblings(pages: DataFrame, source: str, index: str, image: str) -> DataFrame:
    """(image, sibling): other images of the same source page, such as the halves of a split scan."""
    other = pages.select(source, index, F.col(image).alias("sibling"))
    return pages.select(source, index, image).join(other, [source, index]).where(F.col(image) != F.col("sibling")).select(image, "sibling")


def crop_sources(crops: DataFrame, pages: DataFrame, image: str, page_image: str, source: str) -> DataFrame:
    """Crops with the source of the page whose image name, without extension, they name."""
    named = pages.select(X.card_stem(F.col(page_image)).alias("_stem"), source).dropDuplicates(["_stem"])
    return crops.join(named, X.card_stem(F.col(image)) == F.col("_stem"), "left").drop("_stem")


def staged_number(table_number: Column, drawing_number: Column) -> Column:
    """The table's number, else the drawing's, else a question mark."""
    some = lambda c: F.when(F.trim(X.clean_text(c)) != "", F.trim(X.clean_text(c)))
    return F.coalesce(some(table_number), some(drawing_number), F.lit("?"))


def query_set_faults(queries: DataFrame, targets: DataFrame, number: str, query: str, target: str, n: int) -> DataFrame:
    """(fault, value): numbers of 1 to n that are missing or repeated, repeated queries, unknown targets, and targets with several references. Empty for a sound set."""
    spark = queries.sparkSession
    wanted = spark.range(1, n + 1).select(F.col("id").cast("string").alias("value"))
    have = queries.select(F.col(number).cast("string").alias("value"))
    fault = lambda df, name: df.select(F.lit(name).alias("fault"), "value")
    twice = lambda df: df.groupBy("value").count().where("count > 1")
    known = targets.select(F.col(target).cast("string").alias("value"))
    asked = queries.select(F.col(target).cast("string").alias("value")).distinct()
    return (
        fault(wanted.join(have, "value", "left_anti"), "missing_number")
        .unionByName(fault(twice(have), "repeated_number"))
        .unionByName(fault(twice(queries.select(F.col(query).cast("string").alias("value"))), "repeated_query"))
        .unionByName(fault(asked.join(known, "value", "left_anti"), "unknown_target"))
        .unionByName(fault(twice(known.join(asked, "value", "left_semi")), "several_references"))
    )


def restorable(manifest: DataFrame, current: DataFrame, files: DataFrame, key: str, status: str, file: str, good: list[str]) -> DataFrame:
    """Manifest entries with a reviewed status whose file exists and that the current reviews lack."""
    return manifest.where(F.col(status).isin(good)).join(files.select(file), file, "left_semi").join(current.select(key), key, "left_anti")


def state_totals(figures: DataFrame) -> DataFrame:
    """Figures, and those ready, reviewed and unresolved, from link_state columns ready and review_status."""
    done = F.col("review_status") == "approved"
    return figures.agg(F.count(F.lit(1)).alias("figures"), F.count_if("ready").alias("ready"), F.count_if(done).alias("reviewed"), F.count_if(~done & ~F.col("ready")).alias("unresolved"))
