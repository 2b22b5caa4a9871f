"""Mixing sources to target weights by hierarchical budgeting, in DataFrame
functions only.

Documents are leaves of a tree domain > language > source. A token budget runs
down the tree by weight. A child that cannot use its share (its documents times
the epochs allowed) takes what it can; the rest goes to its siblings by weight
and leaves their parent only when the whole family is full, as the parent's own
capacity is the sum of theirs. Every leaf then takes the token-prefix of its
quota from a sequence of epochs, each in a seeded order of its own: whole
epochs, then documents of the last one until the quota is met, the document
that reaches it included.

Sums are over all documents. The order inside a leaf is the MD5 of seed, epoch,
id and the text's own MD5, and is never sorted as a whole: its first
digits deal the documents into slots, slot totals say in which slot the quota
ends, and that slot is dealt again by the next digits until it is small. Only
then are its rows ordered, by keys without texts, to find the last document
that is taken; every text is then compared with that key where it lies.

Arithmetic is in whole numbers. Weights are small whole numbers: weights times
tokens have to fit 63 bits, else Spark raises an overflow.

Defined results: null language or source is ``unknown``; a document's tokens
are its words; documents without words come along where the prefix passes
them; a node of weight 0 gets nothing; shares round down, so up to one token
per child stays unspent; an empty table gives no rows; rows that repeat an id
are taken separately, and of rows that repeat id and text as many as the quota
needs, each task that reads some its share. Texts of any length count whole.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shelfloom.llm.common import fenced, materialise

SLOT_HEX = 2  # a slot is dealt into 16**2
SLOT_ROWS = 1024  # a slot of so many rows is ordered
ORDER_HEX = 32
UNKNOWN = "unknown"
LEAF = ["_domain", "_lang", "_source"]
WORD = "[^\\x20\\x09-\\x0D]+"


@dataclass(frozen=True)
class Mix:
    """Target weights and limits. The budget is ``share`` of all tokens, a
    fraction of whole numbers."""

    domain: dict[str, int] = field(default_factory=lambda: {"d0": 4, "d1": 3, "d2": 2, "d3": 1})
    language: dict[str, int] = field(default_factory=lambda: {"en": 5, "de": 2, "fr": 2, "es": 1})
    other: int = 1
    share: tuple[int, int] = (3, 5)
    epochs: int = 3
    seed: int = 17


def domain_of(source: F.Column) -> F.Column:
    """The domain of a source: the rest by four of the number that ends its
    name; ``other`` without one."""
    digits = F.regexp_extract(source, "([0-9]{1,9})$", 1)
    return F.when(digits == "", F.lit("other")).otherwise(F.concat(F.lit("d"), (F.try_to_number(digits, F.lit("999999999")).cast("int") % 4).cast("string")))


def _weight(column: str, weights: dict[str, int], other: int) -> F.Column:
    out = F.lit(other)
    for name, w in weights.items():
        out = F.when(F.col(column) == name, F.lit(w)).otherwise(out)
    return out.cast("long")


def shared_out(nodes: DataFrame, parent: list[str]) -> DataFrame:
    """``nodes`` (*parent, _cap, _weight, _budget of the parent) with ``_got``:
    the budget by weight, no node over its capacity, shortages to siblings."""
    nodes = nodes.withColumn("_ratio", F.when(F.col("_weight") > 0, F.col("_cap") / F.col("_weight")).otherwise(F.lit(0.0)))
    nodes = nodes.withColumn("_cap", F.when(F.col("_weight") > 0, F.col("_cap")).otherwise(F.lit(0)))
    ordered = Window.partitionBy(*parent).orderBy("_ratio", "_node")
    before = ordered.rowsBetween(Window.unboundedPreceding, -1)
    after = ordered.rowsBetween(0, Window.unboundedFollowing)
    family = Window.partitionBy(*parent)
    rows = (
        nodes.withColumn("_given", F.least("_budget", F.sum("_cap").over(family)))
        .withColumn("_used", F.coalesce(F.sum("_cap").over(before), F.lit(0)))
        .withColumn("_left", F.sum("_weight").over(after))
        .withColumn("_full", F.col("_cap") * F.col("_left") <= F.col("_weight") * (F.col("_given") - F.col("_used")))
    )
    spent = F.sum(F.when(F.col("_full"), F.col("_cap")).otherwise(F.lit(0))).over(family)
    open_weight = F.sum(F.when(F.col("_full"), F.lit(0)).otherwise(F.col("_weight"))).over(family)
    rows = rows.withColumn("_rest", F.col("_given") - spent).withColumn("_open", open_weight)
    got = F.when(F.col("_full"), F.col("_cap")).otherwise(F.expr("(_weight * _rest) div greatest(_open, 1)"))
    return rows.withColumn("_got", got).drop("_ratio", "_given", "_used", "_left", "_full", "_rest", "_open")


def leaf_quotas(docs: DataFrame, mix: Mix) -> DataFrame:
    """(_domain, _lang, _source, _supply, _quota) of every leaf."""
    leaves = docs.groupBy(*LEAF).agg(F.sum("_n").alias("_supply"))
    leaves = leaves.withColumn("_cap", F.col("_supply") * mix.epochs)
    num, den = mix.share
    # Sums of sums up the tree: a few rows per domain, language and source.
    langs = leaves.groupBy("_domain", "_lang").agg(F.sum("_cap").alias("_cap"))
    domains = langs.groupBy("_domain").agg(F.sum("_cap").alias("_cap"))
    total = leaves.agg(F.expr(f"(coalesce(sum(_supply), 0) * {num}) div {den}").alias("_budget"))
    top = domains.withColumn("_root", F.lit(0)).join(total.withColumn("_root", F.lit(0)), "_root")
    top = top.withColumn("_node", F.col("_domain")).withColumn("_weight", _weight("_domain", mix.domain, mix.other))
    got = shared_out(top, ["_root"]).select("_domain", F.col("_got").alias("_budget"))
    mid = langs.join(got, "_domain").withColumn("_node", F.col("_lang")).withColumn("_weight", _weight("_lang", mix.language, mix.other))
    got = shared_out(mid, ["_domain"]).select("_domain", "_lang", F.col("_got").alias("_budget"))
    low = leaves.join(got, ["_domain", "_lang"]).withColumn("_node", F.col("_source")).withColumn("_weight", F.lit(1).cast("long"))
    return shared_out(low, ["_domain", "_lang"]).select("_domain", "_lang", "_source", "_supply", F.col("_got").alias("_quota"))


def prepared(docs: DataFrame, *, id_col: str, text_col: str, lang_col: str, source_col: str) -> DataFrame:
    return docs.withColumns(
        {
            "_lang": F.coalesce(F.col(lang_col), F.lit(UNKNOWN)),
            "_source": F.coalesce(F.col(source_col), F.lit(UNKNOWN)),
            "_n": F.regexp_count(F.coalesce(F.col(text_col), F.lit("")), F.lit(WORD)).cast("long"),
            "_key": F.coalesce(F.col(id_col).cast("string"), F.lit("")),
            "_tie": F.md5(F.coalesce(F.col(text_col), F.lit(""))),
        }
    ).withColumn("_domain", domain_of(F.col("_source")))


def mixed(
    docs: DataFrame,
    mix: Mix | None = None,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    source_col: str = "source",
) -> DataFrame:
    """The chosen rows with all their columns, once for each epoch that takes
    them, and ``domain``, ``epoch`` and ``n_tokens``, which replace columns of
    the same names."""
    mix = mix or Mix()
    rows, names = fenced(docs)
    columns = [F.col(names[c]).alias(c) for c in docs.columns if c.lower() not in ("domain", "epoch", "n_tokens")]
    rows = prepared(rows, id_col=names[id_col], text_col=names[text_col], lang_col=names[lang_col], source_col=names[source_col])
    slim = materialise(rows.select(*LEAF, "_n", "_key", "_tie"), "mix-tokens")
    plan = leaf_quotas(slim, mix).filter("_quota > 0 and _supply > 0")
    plan = materialise(plan.selectExpr(*LEAF, "_quota div _supply as _whole", "_quota % _supply as _part"), "mix-quotas")
    order = F.md5(F.concat_ws(":", F.lit(str(mix.seed)), (F.col("_whole") + 1).cast("string"), F.col("_key"), F.col("_tie")))
    ends = materialise(plan.join(cuts(slim, plan, order), LEAF, "left"), "mix-ends")
    placed = rows.join(ends, LEAF).withColumn("_order", order)
    taken = F.col("_order") < F.col("_cut")
    split = ends.filter("_most < _rows")
    repeats = not split.isEmpty()  # rows of one id and text, of which some are taken
    if not repeats:
        taken = F.col("_order") <= F.col("_cut")
    times = F.col("_whole").cast("int") + F.coalesce(taken, F.lit(False)).cast("int")
    chosen = placed.withColumn("_times", times).filter("_times > 0").withColumn("epoch", F.explode(F.sequence(F.lit(1), F.col("_times"))))
    if repeats:
        edge = _some_of(placed.filter("_order = _cut"))
        chosen = chosen.drop("_times").unionByName(edge.withColumn("epoch", (F.col("_whole") + 1).cast("int")))
    return chosen.select(*columns, F.col("_domain").alias("domain"), "epoch", F.col("_n").alias("n_tokens"))


def _some_of(rows: DataFrame) -> DataFrame:
    """``_most`` of the rows of each leaf, all of which have one id and text. The tasks that read them take their share:
    as many as are left by those before them, so no task gets a leaf's rows together."""
    rows = materialise(rows.withColumn("_task", F.spark_partition_id()), "mix-edge")
    counts = rows.groupBy(*LEAF, "_task", "_most").agg(F.count(F.lit(1)).alias("_here"))
    # one row a leaf and task
    before = F.sum("_here").over(Window.partitionBy(*LEAF).orderBy("_task")) - F.col("_here")
    shares = counts.select(*[F.col(c).alias(f"{c}_of") for c in LEAF], F.col("_task").alias("_task_of"), (F.col("_most") - before).alias("_share"))
    shares = materialise(shares.filter("_share > 0"), "mix-shares")
    same = F.col("_task") == F.col("_task_of")
    for c in LEAF:
        same = same & (F.col(c) == F.col(f"{c}_of"))
    number = F.row_number().over(Window.partitionBy(*LEAF, "_task").orderBy("_order"))
    out = rows.join(shares, same).withColumn("_number", number).filter("_number <= _share")
    return out.drop("_number", "_share", "_task", "_task_of", *[f"{c}_of" for c in LEAF])


def cuts(slim: DataFrame, plan: DataFrame, order: F.Column) -> DataFrame:
    """(*LEAF, _cut, _rows, _most) of every leaf with a part of an epoch: the
    order of the last document taken, its rows, and how many of them are taken
    at most."""
    inside = slim.join(plan.filter("_part > 0"), LEAF).withColumn("_order", order)
    ends, digits = None, 0
    while digits < ORDER_HEX:
        digits += SLOT_HEX
        if ends is not None:
            inside = slim.join(ends, LEAF).withColumn("_order", order).filter(F.col("_order").startswith(F.col("_slot")))
        else:
            inside = inside.withColumn("_start", F.lit(0).cast("long"))
        slots = inside.groupBy(*LEAF, "_whole", "_part", "_start", F.substring("_order", 1, digits).alias("_next")).agg(
            F.sum("_n").alias("_tokens"), F.when(F.min("_order") < F.max("_order"), F.count(F.lit(1))).otherwise(1).alias("_rows")
        )
        # at most 16**SLOT_HEX rows a leaf, whatever its size
        upto = F.sum("_tokens").over(Window.partitionBy(*LEAF).orderBy("_next"))
        slots = slots.withColumn("_before", F.col("_start") + upto - F.col("_tokens")).filter("_part > _before")
        last = F.max(F.struct("_next", "_before", "_rows")).alias("_last")
        ends = slots.groupBy(*LEAF, "_whole", "_part").agg(last).select(
            *LEAF, "_whole", "_part", F.col("_last._next").alias("_slot"), F.col("_last._before").alias("_start"), F.col("_last._rows").alias("_rows")
        )
        ends = materialise(ends, "mix-slots")
        largest = ends.agg(F.max("_rows")).first()[0]
        if largest is None or largest <= SLOT_ROWS:
            break
    inside = slim.join(ends, LEAF).withColumn("_order", order).filter(F.col("_order").startswith(F.col("_slot")))
    # rows of equal order have equal texts, so equal tokens
    ties = inside.groupBy(*LEAF, "_part", "_start", "_order").agg(F.max("_n").alias("_n"), F.count(F.lit(1)).alias("_rows"))
    upto = F.sum(F.col("_n") * F.col("_rows")).over(Window.partitionBy(*LEAF).orderBy("_order"))
    ties = ties.withColumn("_left", F.col("_part") - (F.col("_start") + upto - F.col("_n") * F.col("_rows"))).filter("_left > 0")
    end = ties.groupBy(*LEAF).agg(F.max(F.struct("_order", "_n", "_rows", "_left")).alias("_e"))
    most = F.when(F.col("_e._n") == 0, F.col("_e._rows")).otherwise(F.expr("(_e._left + _e._n - 1) div _e._n"))
    return end.select(*LEAF, F.col("_e._order").alias("_cut"), F.col("_e._rows").alias("_rows"), most.alias("_most"))


def query(spark: SparkSession, documents: DataFrame) -> DataFrame:
    rows = mixed(documents.select("doc_id", "text", "lang", "source"))
    return rows.select("doc_id", "domain", "lang", "source", "epoch", "n_tokens")


def _case(column: str, weights: dict[str, int], other: int) -> str:
    return f"CASE {column} " + " ".join(f"WHEN '{k}' THEN {w}" for k, w in weights.items()) + f" ELSE {other} END"


def _level(name: str, source: str, parent: str) -> str:
    """CTEs that share a budget out among the rows of ``source``."""
    by = f"PARTITION BY {parent}"
    return f"""
{name}_a AS (SELECT *, least(budget, sum(cap) OVER ({by})) AS given,
    coalesce(sum(cap) OVER ({by} ORDER BY cap / weight, node ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used,
    sum(weight) OVER ({by} ORDER BY cap / weight, node ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS left_w FROM {source}),
{name}_b AS (SELECT *, cap * left_w <= weight * (given - used) AS full_up FROM {name}_a),
{name}_c AS (SELECT *, given - sum(CASE WHEN full_up THEN cap ELSE 0 END) OVER ({by}) AS rest,
    sum(CASE WHEN full_up THEN 0 ELSE weight END) OVER ({by}) AS open_w FROM {name}_b),
{name} AS (SELECT *, CASE WHEN full_up THEN cap ELSE (weight * rest) // greatest(open_w, 1) END AS got FROM {name}_c)"""


def oracle(mix: Mix | None = None) -> str:
    mix = mix or Mix()
    num, den = mix.share
    return f"""
WITH docs AS (SELECT doc_id, lang, source, coalesce(lang, 'unknown') AS l, coalesce(source, 'unknown') AS s,
    len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS n,
    md5(coalesce(text, '')) AS t FROM documents),
tree AS (SELECT *, CASE WHEN regexp_extract(s, '([0-9]{{1,9}})$', 1) = '' THEN 'other'
    ELSE 'd' || (CAST(regexp_extract(s, '([0-9]{{1,9}})$', 1) AS INT) % 4) END AS d FROM docs),
leaves AS (SELECT d, l, s, sum(n) AS supply, sum(n) * {mix.epochs} AS cap FROM tree GROUP BY ALL),
top AS (SELECT 0 AS root, d, d AS node, sum(cap) AS cap, {_case("d", mix.domain, mix.other)} AS weight,
    ((SELECT sum(n) FROM docs) * {num}) // {den} AS budget FROM leaves GROUP BY d),
{_level("lev1", "top", "root")},
mid AS (SELECT leaves.d, l, l AS node, sum(leaves.cap) AS cap, {_case("l", mix.language, mix.other)} AS weight, any_value(got) AS budget
    FROM leaves JOIN lev1 ON leaves.d = lev1.d GROUP BY leaves.d, l),
{_level("lev2", "mid", "d")},
low AS (SELECT leaves.d, leaves.l, s, s AS node, supply, leaves.cap, 1 AS weight, got AS budget
    FROM leaves JOIN lev2 ON leaves.d = lev2.d AND leaves.l = lev2.l),
{_level("lev3", "low", "d, l")},
plan AS (SELECT d, l, s, got // supply AS whole, got % supply AS part FROM lev3 WHERE got > 0 AND supply > 0),
placed AS (SELECT tree.*, whole, part, md5('{mix.seed}:' || (whole + 1) || ':' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || t) AS o
    FROM tree JOIN plan USING (d, l, s)),
run AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY d, l, s ORDER BY o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM placed)
SELECT doc_id, d AS domain, lang, source, CAST(e AS INTEGER) AS epoch, CAST(n AS BIGINT) AS n_tokens
FROM (SELECT *, unnest(range(1, CAST(whole AS BIGINT) + 1)) AS e FROM placed WHERE whole > 0)
UNION ALL
SELECT doc_id, d, lang, source, CAST(whole + 1 AS INTEGER), CAST(n AS BIGINT) FROM run WHERE before < part
"""
