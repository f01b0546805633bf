"""Linking numbered items to table rows, with warnings, overrides and guarded writes."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kilnwork.functions import text as X

#: Warnings that never block (fixed values).
NOT_BLOCKING = ["low_ocr_confidence", "row_anchor_conflict_resolved", "cross_column_ocr_withheld"]
#: The override reason that a warning takes; others take reviewer_confirmed (fixed values).
REASONS = {"missing_required_value": "publication_field_blank", "column_header_fallback": "column_alignment_verified", "missing_table_row": "confirmed_missing_table_row"}
#: Measurements good enough to be written (fixed values).
VERIFIED = ["verified", "verified_automatic", "verified_manual"]


def unique_key_link(left: DataFrame, right: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Each left row with n_left and n_right, the rows of its key on either side, status and the right row's values.

    ready if the key has exactly one row on both sides; otherwise needs_review, with null values. A null key is never
    ready. Only counts and one candidate of each right key are joined, so a hot key multiplies nothing.
    """
    counts = left.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_left"))
    found = right.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_right"), *[F.min(v).alias(v) for v in values])
    out = left.drop(*values).join(counts, keys, "left").join(found, keys, "left")
    ready = F.coalesce((F.col("n_left") == 1) & (F.col("n_right") == 1), F.lit(False))
    return out.withColumns(
        {"n_left": F.coalesce("n_left", F.lit(0)).cast("long"), "n_right": F.coalesce("n_right", F.lit(0)).cast("long"), "status": F.when(ready, "ready").otherwise("needs_review")} | {v: F.when(ready, F.col(v)) for v in values}
    )


def link_warnings(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, code, n): duplicates on either side, keys of the left without a right row, and of the right without a left row."""
    a = left.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_left"))
    b = right.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_right"))
    both = a.join(b, keys, "full")
    l, r = F.coalesce("n_left", F.lit(0)), F.coalesce("n_right", F.lit(0))
    codes = F.filter(
        F.array(
            F.when(l > 1, F.struct(F.lit("duplicate_drawing_number").alias("code"), l.alias("n"))),
            F.when(r > 1, F.struct(F.lit("duplicate_table_number").alias("code"), r.alias("n"))),
            F.when(r == 0, F.struct(F.lit("missing_table_row").alias("code"), l.alias("n"))),
            F.when(l == 0, F.struct(F.lit("unexpected_table_row").alias("code"), r.alias("n"))),
        ),
        lambda x: x.isNotNull(),
    )
    return both.select(*keys, F.explode(codes).alias("w")).select(*keys, "w.code", "w.n")


def blocking(code: Column, override_reason: Column) -> Column:
    """Whether a warning blocks: unless its code never does, or an override gives the reason that its code takes."""
    wanted = F.coalesce(F.create_map(*[F.lit(x) for kv in REASONS.items() for x in kv])[code], F.lit("reviewer_confirmed"))
    return ~(code.isin(NOT_BLOCKING) | F.coalesce(override_reason == wanted, F.lit(False)))


def figure_state(matches: DataFrame, warnings: DataFrame, key: str = "figure_key") -> DataFrame:
    """For each figure its matches, ready and ignored ones, blocking warnings, and ready: some match, all of them ready or ignored, nothing blocking."""
    m = matches.groupBy(key).agg(F.count(F.lit(1)).alias("n_matches"), F.count_if(F.col("status").isin("ready", "ignored")).alias("n_settled"))
    w = warnings.groupBy(key).agg(F.count_if(blocking(F.col("code"), F.col("override_reason"))).alias("n_blocking"))
    out = m.join(w, key, "full").select(key, *[F.coalesce(c, F.lit(0)).alias(c) for c in ("n_matches", "n_settled", "n_blocking")])
    return out.withColumn("ready", (F.col("n_matches") > 0) & (F.col("n_settled") == F.col("n_matches")) & (F.col("n_blocking") == 0))


def collapse_sources(items: DataFrame, group: str, source: str, number: str, order: str, preferred: Column | None = None) -> DataFrame:
    """``items`` without sources that repeat another: within a group the keeper is the preferred source, or the first
    seen; another source goes if its sorted numbers equal the keeper's. A keeper with no, blank or repeated numbers
    collapses nothing. Each source's numbers become one digest-sized array before groups meet."""
    wanted = F.lit(False) if preferred is None else preferred
    sides = items.groupBy(group, source).agg(
        F.min(order).alias("_seen"),
        F.sort_array(F.collect_list(F.coalesce(number, F.lit("")))).alias("_numbers"),
        F.max(wanted.cast("int")).alias("_wanted"),
    )
    keeper = sides.groupBy(group).agg(F.min_by(F.struct(F.col(source).alias("source"), F.col("_numbers").alias("numbers")), F.struct(-F.col("_wanted"), "_seen", source)).alias("_keeper"))
    usable = (F.size("_keeper.numbers") > 0) & ~F.array_contains("_keeper.numbers", "") & (F.size(F.array_distinct("_keeper.numbers")) == F.size("_keeper.numbers"))
    gone = sides.join(keeper, group).where(usable & (F.col(source) != F.col("_keeper.source")) & (F.col("_numbers") == F.col("_keeper.numbers"))).select(group, source)
    return items.join(gone, [group, source], "left_anti")


def ownership_upsert(current: DataFrame, incoming: DataFrame, key: str, columns: list[str], replace: bool) -> DataFrame:
    """``current`` (key, each column and applied_<column>) with incoming values written where a cell is blank, or where
    ``replace`` is set and the cell still has the value applied last. What is written becomes the applied value.
    Blank incoming values write nothing."""
    new = incoming.select(key, *[F.col(c).alias(f"_new_{c}") for c in columns])
    out = current.join(new, key, "left")
    made = {}
    for c in columns:
        cell, applied, value = F.coalesce(c, F.lit("")), F.col(f"applied_{c}"), F.coalesce(f"_new_{c}", F.lit(""))
        may = (cell == "") | (F.lit(replace) & applied.isNotNull() & (cell == applied))
        write = may & (value != "")
        made |= {c: F.when(write, value).otherwise(cell), f"applied_{c}": F.when(write, value).otherwise(applied)}
    return out.withColumns(made).drop(*[f"_new_{c}" for c in columns])


def unapprovable(targets: DataFrame, catalog: DataFrame, key: str) -> DataFrame:
    """Targets that don't have exactly one catalogue row, with their number of rows. An approval needs this to be empty."""
    n = catalog.groupBy(key).agg(F.count(F.lit(1)).alias("n_rows"))
    return targets.select(key).distinct().join(n, key, "left").withColumn("n_rows", F.coalesce("n_rows", F.lit(0)).cast("long")).where("n_rows <> 1")


def replay_overrides(rows: DataFrame, cells: DataFrame, deleted: DataFrame, added: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Rows after a reviewer's overrides. Deleted keys go; cells (key, column, value) patch; added rows patch the row of
    their key if it is there, and are appended otherwise."""
    kept = rows.join(deleted.select(key).distinct(), key, "left_anti")
    patch = cells.groupBy(key).agg(*[F.max(F.when(F.col("column") == c, F.col("value"))).alias(f"_cell_{c}") for c in columns])
    kept = kept.join(patch, key, "left").select(key, *[F.coalesce(f"_cell_{c}", c).alias(c) for c in columns])
    extra = added.groupBy(key).agg(*[F.min(c).alias(f"_add_{c}") for c in columns], F.lit(True).alias("_added"))
    return kept.join(extra, key, "full").select(key, *[F.when(F.col("_added"), F.col(f"_add_{c}")).otherwise(F.col(c)).alias(c) for c in columns])


def unmatched_overrides(rows: DataFrame, cells: DataFrame, deleted: DataFrame, key: str) -> DataFrame:
    """Keys of cells and deletions that no row has."""
    return cells.select(key).unionByName(deleted.select(key)).distinct().join(rows.select(key), key, "left_anti")


def row_differences(stored: DataFrame, submitted: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """(key, kind, column, value): cells that differ, rows that are gone and rows that are new."""
    a, b = stored.select(key, F.lit(1).alias("_a"), *[F.col(c).alias(f"_a_{c}") for c in columns]), submitted.select(key, F.lit(1).alias("_b"), *[F.col(c).alias(f"_b_{c}") for c in columns])
    both = a.join(b, key, "full")
    changes = F.filter(F.array(*[F.when(~F.col(f"_a_{c}").eqNullSafe(F.col(f"_b_{c}")), F.struct(F.lit("cell").alias("kind"), F.lit(c).alias("column"), F.col(f"_b_{c}").cast("string").alias("value"))) for c in columns]), lambda x: x.isNotNull())
    none = F.lit(None).cast("string")
    found = (
        F.when(F.col("_b").isNull(), F.array(F.struct(F.lit("deleted").alias("kind"), none.alias("column"), none.alias("value"))))
        .when(F.col("_a").isNull(), F.array(F.struct(F.lit("added").alias("kind"), none.alias("column"), none.alias("value"))))
        .otherwise(changes)
    )
    return both.select(key, F.explode(found).alias("d")).select(key, "d.kind", "d.column", "d.value")


def public_columns(df: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """Each (public, legacy) pair as one public column: its own value unless blank, else the legacy one; legacy columns go."""
    made = {p: F.when(X.clean_text(F.col(p)) != "", F.col(p)).otherwise(X.clean_text(F.col(old))) if p in df.columns else X.clean_text(F.col(old)) for p, old in pairs if old in df.columns}
    return df.withColumns(made).drop(*[old for _, old in pairs])


def unique_names(df: DataFrame, base: str, order: list[str], name: str = "name") -> DataFrame:
    """A name for each row, in order: base, or base-2, base-3 ..., the first that no row before has but for case; null for a null base.

    A name of a base x can only clash with those of rows whose base is x-k. Such a base keeps its name if its first row
    comes before x gets to k, and x skips k then; otherwise all its rows are numbered. That is settled for the distinct
    bases, one root (base without its last numbers) after the other; rows are only counted, in sorts of one base.
    """
    low, at = F.lower(base).alias("_low"), F.struct(*order, base).alias("_at")
    keys = df.select(low, at).where("_low is not null")
    first = keys.groupBy("_low").agg(F.min("_at").alias("_at"))
    last = r"(?s)^(.*)-([1-9][0-9]{0,14})$"
    numbered = first.select(F.regexp_extract("_low", last, 1).alias("_parent"), F.regexp_extract("_low", last, 2).try_cast("long").alias("_k"), F.col("_low").alias("_child"), "_at").where("_k >= 2")
    edges = numbered.join(first.select(F.col("_low").alias("_parent")), "_parent", "left_semi")
    # Of x's rows, those before the first row of x-k.
    some = keys.join(edges.select(F.col("_parent").alias("_low")).distinct(), "_low", "left_semi").select(F.col("_low").alias("_parent"), "_at", F.lit(1).alias("_one"))
    # Structs, as both sides are dealt out by _parent already: Spark would not deal out their union anew, but may have joined partitions of one side.
    before = F.sum("_one").over(W.partitionBy("_by").orderBy("_at", F.col("_one").desc()).rowsBetween(W.unboundedPreceding, 0))
    met = some.unionByName(edges.withColumn("_one", F.lit(0)), allowMissingColumns=True).withColumn("_by", F.struct("_parent")).withColumn("_before", before).where("_one = 0")
    root = F.regexp_replace("_parent", r"(-\d+)+$", "")
    settled = met.select(root.alias("_root"), "_parent", "_k", "_child", "_before").groupBy("_root").applyInPandas(_settled, "_low string, _n long, _step int")

    rows = df.withColumns({"_low": F.lower(base), "_n": F.row_number().over(W.partitionBy(F.lower(base)).orderBy(*order, base)).cast("long"), "_step": F.lit(None).cast("int")})
    # Steps come before the row that they move; one of 0 says that the base's first row is numbered too.
    steps = rows.unionByName(settled.withColumn("_is", F.lit(0)), allowMissingColumns=True).withColumn("_is", F.coalesce("_is", F.lit(1)))
    so_far = W.partitionBy("_low").orderBy("_n", "_is").rowsBetween(W.unboundedPreceding, 0)
    moved = steps.withColumns({"_moved": F.coalesce(F.sum("_step").over(so_far), F.lit(0)), "_all": F.coalesce(F.max(F.col("_step") == 0).over(so_far), F.lit(False))}).where("_is = 1")
    number = F.col("_n") + F.col("_moved") + F.col("_all").cast("int")
    own = (F.col("_n") == 1) & ~F.col("_all")
    return moved.withColumn(name, F.when(own, F.col(base)).otherwise(F.concat(F.col(base), F.lit("-"), number.cast("string")))).select(*df.columns, name)


def _settled(pdf: pd.DataFrame) -> pd.DataFrame:
    """For a root's bases x-k: (x, n, 1) where x skips a number from its n-th row on, (x-k, 0, 0) where x has the name x-k."""
    taken: set[str] = set()
    out = []
    pdf = pdf.assign(_long=pdf["_parent"].str.len()).sort_values(["_long", "_parent", "_k"])
    parent, own, skipped = None, 1, 0
    for x, k, child, before in zip(pdf["_parent"], pdf["_k"], pdf["_child"], pdf["_before"], strict=True):
        if x != parent:
            parent, own, skipped = x, int(x not in taken), 0
        # x gets to k with the (k - 1 - skipped)-th of its numbered rows.
        if max(before - own, 0) <= k - 2 - skipped:
            skipped += 1
            out.append((x, k - skipped + own, 1))
        else:
            taken.add(child)
            out.append((child, 0, 0))
    return pd.DataFrame(out, columns=["_low", "_n", "_step"])


def split_with_donors(df: DataFrame, key: str, name: str = "part", least: int = 10) -> DataFrame:
    """Distinct keys with train, validation or test by their digest; with ``least`` keys or more, validation and then test,
    where empty, take the last key of the largest part (the first of equals in that order)."""
    parts = ["train", "validation", "test"]
    each = df.select(F.col(key)).distinct().withColumn(name, X.split_of(F.col(key)))
    facts = {r[name]: r["n"] for r in each.groupBy(name).agg(F.count(F.lit(1)).alias("n")).collect()}
    held = {p: facts.get(p, 0) for p in parts}
    if sum(held.values()) < least:
        return each
    moved: dict[str, str] = {}
    for p in parts[1:]:
        if not held[p]:
            donor = max(parts, key=lambda q: held[q])
            # A part gives at most two keys, its last ones.
            last = [r[0] for r in each.where(F.col(name) == donor).orderBy(F.col(key).desc()).limit(2).collect() if r[0] not in moved]
            moved[last[0]] = p
            held[donor] -= 1
            held[p] += 1
    if not moved:
        return each
    return each.withColumn(name, F.coalesce(F.create_map(*[F.lit(x) for kv in moved.items() for x in kv])[F.col(key)], F.col(name)))


def joined_distinct(value: Column, order: Column, sep: str = "; ") -> Column:
    """An aggregate: distinct values in order of first sight, joined."""
    seen = F.transform(F.array_sort(F.collect_set(F.struct(order.alias("at"), value.alias("value")))), lambda x: x["value"])
    return F.array_join(F.array_distinct(seen), sep)


def multi_key_lookup(left: DataFrame, right: DataFrame, keys: list[str], key: str, values: list[str]) -> DataFrame:
    """Left rows with the values of the first of several keys that the right table (one row for each key) has."""
    row = left.withColumn("_row", F.struct(*[F.col(c) for c in left.columns]))
    tried = row.select("_row", F.posexplode(F.array(*[F.col(k).cast("string") for k in keys])).alias("_at", key)).where(F.col(key).isNotNull())
    hit = tried.join(right.select(F.col(key).cast("string").alias(key), *values), key).groupBy("_row").agg(F.min_by(F.struct(*values), "_at").alias("_hit"))
    return left.withColumn("_row", F.struct(*[F.col(c) for c in left.columns])).join(hit, "_row", "left").select(*left.columns, *[F.col(f"_hit.{v}").alias(v) for v in values])


def key_collisions(df: DataFrame, key: str, identity: str, members: str) -> DataFrame:
    """Rows with their key; where rows of different identities share a key, or it is blank, each takes the digest of its
    members, or where that is another row's own key already, the digest of that and its identity."""
    k = F.coalesce(F.col(key).cast("string"), F.lit(""))
    rows = df.withColumns({"_key": k, "_made": X.figure_key(F.col(members))})
    facts = rows.groupBy("_key").agg((F.count_distinct(F.struct(F.coalesce(F.col(identity).cast("string"), F.lit("")), "_made")) > 1).alias("_several"))
    rows = rows.join(facts, "_key").withColumn("_split", (F.col("_key") == "") | F.col("_several"))
    used = rows.where(~F.col("_split")).select(F.col("_key").alias("_made"), F.lit(True).alias("_used")).distinct()
    # Of split rows with the same made key the first identity keeps it.
    first = rows.where("_split").groupBy("_made").agg(F.min(F.coalesce(F.col(identity).cast("string"), F.lit(""))).alias("_first"))
    out = rows.join(used, "_made", "left").join(first, "_made", "left")
    own = F.coalesce(F.col(identity).cast("string"), F.lit(""))
    again = F.col("_used").isNotNull() | (own != F.col("_first"))
    made = F.when(again, F.substring(F.sha2(F.concat_ws("|", F.col("_made"), own), 256), 1, 20)).otherwise(F.col("_made"))
    return out.withColumn(key, F.when(F.col("_split"), made).otherwise(F.col("_key"))).select(*df.columns)
