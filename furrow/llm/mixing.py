"""Mixing sources to target weights, by hierarchical budgets (operator 9).

The tree is domain, language, source; a leaf holds the tokens (words) of its
documents, available for up to ``epochs`` passes.  A budget of tokens goes down
the tree: children share their parent's budget by weight, a child takes no more
than it holds, and what it leaves goes to its siblings by weight; what all
children together can't take never reaches the parent, because a node's
capacity is the sum of its children's.  Siblings are settled in closed form: in
ascending order of capacity by weight, children take all they hold until the
first that can't use its share; from there on the rest is dealt by weight.  All
of it is integer arithmetic in windows over the small table of nodes.

A leaf takes whole passes first and then a prefix of the next pass: documents
in the order of a hash of (seed, pass, doc_id) while their tokens fit.  The
prefix is found from the token sums of hash slots; only the slot in which it
ends is put in order, so no leaf, however large, is sorted in one task.

Only DataFrame and SQL functions are used.

Defined cases: documents without words are never chosen; a null language or
source is a leaf of its own under the name ``none``; weights that are missing
use the default; rows with one doc_id are separate documents that stand together
in the order (ties go by tokens, so equal rows are interchangeable); an empty
table gives an empty result; further columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from furrow.plans.session import cut_lineage

LEVELS = ("domain", "lang", "source")
SLOT_DIGITS = 3  # hexadecimal digits of a hash slot
SPLIT = "[\\x20\\x09-\\x0D]+"

# production parameters of the registered query
SEED = 17
EPOCHS = 3
SHARE = 60  # per cent of the corpus' tokens
DOMAINS = {"web": 45, "news": 20, "books": 20, "talk": 15}
LANGUAGES = {"en": 55, "de": 15, "fr": 15, "es": 15}
DEFAULT_WEIGHT = 10


def domain_of_source() -> Column:
    """Domain by the number in the source's name: five sources each, the rest is talk."""
    number = F.expr("try_cast(regexp_extract(source, '([0-9]+)', 1) AS INT)")
    return F.when(number < 5, "web").when(number < 10, "news").when(number < 15, "books").otherwise(
        "talk")


def words(column: str = "text") -> Column:
    """Number of words of a text."""
    parts = F.split(F.coalesce(column, F.lit("")), SPLIT)
    first, last = F.element_at(parts, 1), F.element_at(parts, -1)
    blank = F.when(first == "", 1).otherwise(0) + F.when(
        (F.size(parts) > 1) & (last == ""), 1).otherwise(0)
    return (F.size(parts) - blank).cast("long")


def _weight(level: str, weights: Mapping[str, int], default: int) -> Column:
    out = None
    for name, value in weights.items():
        hit = F.col(level) == name
        out = F.when(hit, value) if out is None else out.when(hit, value)
    default = F.lit(default)
    return (default if out is None else out.otherwise(default)).cast("long")


def deal_among_siblings(
    nodes: DataFrame, parent: Sequence[str], name: str, out: str,
) -> DataFrame:
    """Adds column ``out``: what each child gets of its parent's ``budget``.

    ``nodes`` has the parent's keys and budget and per child ``name``, capacity
    and weight (positive).
    """
    near = Window.partitionBy(*parent).orderBy(
        (F.col("capacity") / F.col("weight")).asc(), F.col(name).asc())
    before = near.rowsBetween(Window.unboundedPreceding, -1)
    after = near.rowsBetween(0, Window.unboundedFollowing)
    left = F.col("budget") - F.coalesce(F.sum("capacity").over(before), F.lit(0))
    rows = nodes.withColumn("_left", left).withColumn("_weights", F.sum("weight").over(after))
    full = (F.col("capacity").cast("decimal(19,0)") * F.col("_weights").cast("decimal(18,0)")
            <= F.col("_left").cast("decimal(19,0)") * F.col("weight").cast("decimal(18,0)"))
    rows = rows.withColumn("_full", full)
    # the first child that isn't full has the largest sum of weights still to serve
    rows = rows.withColumn("_open", F.max_by(
        F.struct("_left", "_weights"), F.when(~F.col("_full"), F.col("_weights"))).over(
        Window.partitionBy(*parent)))
    part = F.expr("cast(_open._left as decimal(19,0)) * cast(weight as decimal(18,0)) "
                  "div cast(_open._weights as decimal(18,0))").cast("long")
    got = F.when(F.col("_full"), F.col("capacity")).otherwise(F.least("capacity", part))
    return rows.withColumn(out, F.greatest(got, F.lit(0).cast("long"))).drop(
        "_left", "_weights", "_full", "_open")


def leaf_budgets(
    leaves: DataFrame, budget: Column, epochs: int, weights: Mapping[str, Mapping[str, int]],
    default: int,
) -> DataFrame:
    """domain, lang, source, tokens and budget of every leaf from their tokens.

    ``budget`` is an aggregate over the leaves, for instance a share of all tokens.
    """
    # one row a leaf; a plan over all levels at once is planned again after each of its shuffles
    leaves = cut_lineage(leaves.withColumn("capacity", F.col("tokens") * epochs))
    whole = leaves.agg(budget.cast("long")).first()[0] or 0
    given = None
    for depth, level in enumerate(LEVELS):
        keys = list(LEVELS[:depth])
        nodes = leaves.groupBy(*keys, level).agg(F.sum("capacity").alias("capacity"))
        # the root holds the whole budget; below, a node's budget is what it was dealt
        nodes = nodes.withColumn("budget", F.lit(whole)) if given is None else nodes.join(given, keys)
        nodes = nodes.withColumn("weight", _weight(level, weights.get(level, {}), default))
        given = cut_lineage(deal_among_siblings(nodes, keys, level, "_given").select(
            *keys, level, F.col("_given").alias("budget")))
    return leaves.join(given, list(LEVELS)).drop("capacity")


def mix(
    docs: DataFrame, domain: Column | None = None, weights: Mapping[str, Mapping[str, int]] | None = None,
    share: int = SHARE, epochs: int = EPOCHS, seed: int = SEED, default: int = DEFAULT_WEIGHT,
) -> DataFrame:
    """doc_id, domain, lang, source, n_tokens and copies of every document that is chosen.

    The budget is ``share`` per cent of all tokens.
    """
    weights = {"domain": DOMAINS, "lang": LANGUAGES} if weights is None else weights
    named = docs.select(
        "doc_id", (domain_of_source() if domain is None else domain).alias("domain"),
        F.coalesce("lang", F.lit("none")).alias("lang"),
        F.coalesce("source", F.lit("none")).alias("source"), words().alias("n_tokens"))
    named = cut_lineage(named.where("n_tokens > 0"))
    leaves = named.groupBy(*LEVELS).agg(F.sum("n_tokens").alias("tokens"))
    budget = F.expr(f"(sum(tokens) * {int(share)}) div 100")
    leaves = leaf_budgets(leaves, budget, epochs, weights, default).select(
        *LEVELS, "tokens", F.expr("budget div tokens").alias("passes"),
        F.expr("budget % tokens").alias("rest"))
    leaves = cut_lineage(leaves)
    order = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("passes").cast("string"),
                              F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    rows = named.join(leaves, list(LEVELS)).withColumn("place", order).withColumn(
        "slot", F.substring("place", 1, SLOT_DIGITS))
    slots = rows.groupBy(*LEVELS, "slot").agg(F.sum("n_tokens").alias("slot_tokens"))
    slots = slots.withColumn("before", F.coalesce(F.sum("slot_tokens").over(
        Window.partitionBy(*LEVELS).orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)),
        F.lit(0)))
    rows = rows.join(slots, [*LEVELS, "slot"])
    whole = F.col("before") + F.col("slot_tokens") <= F.col("rest")
    outside = F.col("before") >= F.col("rest")
    columns = ["doc_id", *LEVELS, "n_tokens"]
    sure = rows.where(whole | outside).select(*columns, (F.col("passes") + whole.cast("long")).alias(
        "copies"))
    # the slot in which the prefix ends, one of each leaf
    upto = F.sum("n_tokens").over(Window.partitionBy(*LEVELS, "slot").orderBy(
        "place", "n_tokens").rowsBetween(Window.unboundedPreceding, 0))
    last = rows.where(~whole & ~outside).select(*columns, (F.col("passes") + (
        F.col("before") + upto <= F.col("rest")).cast("long")).alias("copies"))
    return sure.unionByName(last).where("copies > 0")


SQL = f"""
WITH named AS (
  SELECT doc_id, CASE WHEN num < 5 THEN 'web' WHEN num < 10 THEN 'news' WHEN num < 15 THEN 'books'
                      ELSE 'talk' END AS domain,
         coalesce(lang, 'none') AS lang, coalesce(source, 'none') AS source, n_tokens
  FROM (SELECT *, try_cast(regexp_extract(source, '([0-9]+)', 1) AS INT) AS num,
               len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS n_tokens
        FROM documents) WHERE n_tokens > 0),
leaves AS (SELECT domain, lang, source, sum(n_tokens)::HUGEINT AS tokens,
                  sum(n_tokens)::HUGEINT * {EPOCHS} AS capacity FROM named GROUP BY ALL),
d0 AS (SELECT domain, sum(capacity) AS capacity,
              (SELECT sum(tokens) * {SHARE} // 100 FROM leaves) AS budget,
              CASE domain {" ".join(f"WHEN '{k}' THEN {v}" for k, v in DOMAINS.items())}
              ELSE {DEFAULT_WEIGHT} END::HUGEINT AS weight FROM leaves GROUP BY 1),
{{deal_d}},
l0 AS (SELECT domain, lang, sum(capacity) AS capacity, any_value(d3.given) AS budget,
              CASE lang {" ".join(f"WHEN '{k}' THEN {v}" for k, v in LANGUAGES.items())}
              ELSE {DEFAULT_WEIGHT} END::HUGEINT AS weight
       FROM leaves JOIN (SELECT domain, given FROM d3) d3 USING (domain) GROUP BY 1, 2),
{{deal_l}},
s0 AS (SELECT leaves.domain, leaves.lang, source, leaves.capacity, tokens, l3.given AS budget,
              {DEFAULT_WEIGHT}::HUGEINT AS weight
       FROM leaves JOIN (SELECT domain, lang, given FROM l3) l3 USING (domain, lang)),
{{deal_s}},
plan AS (SELECT domain, lang, source, s3.given // tokens AS passes, s3.given % tokens AS rest
         FROM leaves JOIN (SELECT domain, lang, source, given FROM s3) s3 USING (domain, lang, source)),
placed AS (SELECT doc_id, domain, lang, source, n_tokens, passes, rest,
    sum(n_tokens) OVER (PARTITION BY domain, lang, source ORDER BY
      md5('{SEED}|' || passes::BIGINT::VARCHAR || '|' || coalesce(doc_id::VARCHAR, '')), n_tokens
      ROWS UNBOUNDED PRECEDING) AS upto FROM named JOIN plan USING (domain, lang, source))
SELECT doc_id, domain, lang, source, n_tokens::BIGINT AS n_tokens,
       (passes + CASE WHEN upto <= rest THEN 1 ELSE 0 END)::BIGINT AS copies
FROM placed WHERE passes + CASE WHEN upto <= rest THEN 1 ELSE 0 END > 0
"""


def _deal_sql(name: str, parent: str, key: str) -> str:
    over = f"PARTITION BY {parent} " if parent else ""
    order = f"{over}ORDER BY capacity::DOUBLE / weight::DOUBLE, {key}"
    return f"""{name}1 AS (SELECT *,
  budget - coalesce(sum(capacity) OVER ({order} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS lft,
  sum(weight) OVER ({order} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS ws FROM {name}0),
{name}2 AS (SELECT *, capacity * ws <= lft * weight AS filled FROM {name}1),
{name}3 AS (SELECT *, greatest(0, CASE WHEN filled THEN capacity ELSE least(capacity,
  (first_lft * weight) // first_ws) END)::HUGEINT AS given FROM (SELECT *,
  max(CASE WHEN NOT filled THEN ws END) OVER ({over}) AS first_ws,
  arg_max(lft, CASE WHEN NOT filled THEN ws END) OVER ({over}) AS first_lft FROM {name}2))"""


SQL = (SQL.replace("{deal_d}", _deal_sql("d", "", "domain")).replace(
    "{deal_l}", _deal_sql("l", "domain", "lang")).replace(
    "{deal_s}", _deal_sql("s", "domain, lang", "source")))
