"""Mixing sources to target weights by hierarchical budgeting.

A token budget flows down a tree (domain, language, source). At every node it is
shared among the children by weight; a child that holds less than its share takes
all it has and the shortage goes to its siblings. Because a child's capacity is
that of its whole subtree, a shortage is made up as near as possible: inside the
subtree first, and by the ancestors' siblings only when the subtree is used up.
Each leaf then takes the first tokens of its seeded order of documents, epoch after epoch.

Everything is DataFrame operations on exact integers.
"""

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vigilake.llm.common import staged, table

LEVELS = ("domain", "lang", "source")
WORD = r"[^\x20\x09-\x0D]+"
WIDE = "decimal(38,0)"


@dataclass(frozen=True)
class Recipe:
    """Target weights (positive integers) per level; a value that is not listed has ``default``."""

    budget_permille: int = 600  # of the tokens in the input
    max_epochs: int = 2
    seed: str = "mix-1"
    default: int = 10
    domain: tuple[tuple[str, int], ...] = (("web", 40), ("reference", 30), ("forum", 20))
    lang: tuple[tuple[str, int], ...] = (("en", 50), ("de", 20), ("fr", 20))
    source: tuple[tuple[str, int], ...] = (("src0", 20),)

    def weight(self, level: str) -> Column:
        known = F.when(F.lit(False), 0)
        for value, weight in getattr(self, level):
            known = known.when(F.col(level) == value, weight)
        return known.otherwise(self.default).cast(WIDE)


PRODUCTION = Recipe()

# Sources are numbered; their number's group of five is the domain.
DOMAINS = ("web", "reference", "forum", "news")


def domain_of(source: str = "source") -> Column:
    number = F.regexp_extract(F.coalesce(F.col(source), F.lit("")), r"^src(\d{1,4})$", 1)
    group = F.floor(F.when(number != "", number).cast("int") / 5)
    named = F.when(F.lit(False), "")
    for i, name in enumerate(DOMAINS):
        named = named.when(group == i, name)
    return named.otherwise("other")


def token_count(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("bigint")


def share(nodes: DataFrame, group: list[str], budget: Column) -> DataFrame:
    """Water-filling of ``budget`` over the ``nodes`` (weight, capacity) of each group: adds ``granted``.

    Ordered by capacity for weight, the children that take all they have come first:
    child i does so if capacity_i * (weights from i on) <= weight_i * (budget - capacities before i).
    The others share the rest by weight, rounded down.
    """
    by_need = Window.partitionBy(*group).orderBy(F.col("capacity") / F.col("weight"), "capacity", "weight", *LEVELS[: len(group) + 1])
    earlier = by_need.rowsBetween(Window.unboundedPreceding, -1)
    onward = by_need.rowsBetween(0, Window.unboundedFollowing)
    left = budget - F.coalesce(F.sum("capacity").over(earlier), F.lit(0).cast(WIDE))
    marked = nodes.withColumns({"__left": left.cast(WIDE), "__onward": F.sum("weight").over(onward).cast(WIDE)})
    marked = marked.withColumn("__full", F.col("capacity") * F.col("__onward") <= F.col("weight") * F.col("__left"))
    every = Window.partitionBy(*group)
    rest = F.first(F.when(~F.col("__full"), F.struct("__left", "__onward")), ignorenulls=True).over(by_need.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    del every
    marked = marked.withColumn("__rest", rest)
    shared = F.floor(F.col("weight") * F.col("__rest.__left") / F.col("__rest.__onward"))
    return marked.withColumn("granted", F.when(F.col("__full"), F.col("capacity")).otherwise(shared).cast(WIDE)).drop("__left", "__onward", "__full", "__rest")


def budgets(counted: DataFrame, recipe: Recipe = PRODUCTION) -> DataFrame:
    """Leaves (domain, lang, source, docs, tokens, granted) of ``counted`` (the levels and n_tokens).

    NULL levels are nodes of their own. The tables of nodes are as large as the tree,
    not as the input.
    """
    leaves = counted.groupBy(*LEVELS).agg(F.count("*").alias("docs"), F.sum("n_tokens").alias("tokens"))
    leaves = staged(leaves.withColumn("capacity", (F.col("tokens") * recipe.max_epochs).cast(WIDE)), "leaves")
    granted = None
    for depth, level in enumerate(LEVELS, 1):
        path = list(LEVELS[:depth])
        nodes = leaves.groupBy(*path).agg(F.sum("capacity").cast(WIDE).alias("capacity")).withColumn("weight", recipe.weight(level))
        if granted is None:
            total = F.sum("capacity").over(Window.partitionBy(F.lit(0)))
            granted = share(nodes, [], F.floor(total * recipe.budget_permille / (1000 * recipe.max_epochs)).cast(WIDE))
        else:
            above = granted.select(*[F.col(c).alias(f"__{c}") for c in path[:-1]], F.col("granted").alias("__granted"))
            same = [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in path[:-1]]
            joined = nodes.join(above, same).drop(*[f"__{c}" for c in path[:-1]])
            granted = share(joined, path[:-1], F.col("__granted")).drop("__granted")
    kept = granted.select(*[F.col(c).alias(f"__{c}") for c in LEVELS], F.col("granted").cast("bigint").alias("granted"))
    same = [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in LEVELS]
    return leaves.join(kept, same).drop("capacity", *[f"__{c}" for c in LEVELS])


def mix(docs: DataFrame, recipe: Recipe = PRODUCTION, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows of ``docs`` that make up the mix, with domain, epoch, n_tokens and tokens_taken.

    A row comes once for each epoch it is used in. ``tokens_taken`` is less than
    ``n_tokens`` only for the row in which a leaf's budget ends. Texts without tokens
    take no budget: they come with the epochs that begin before it is used up.
    Documents are ordered in an epoch by the digest of seed, epoch and key; ties go
    by key, tokens and text digest, and rows equal in all of them are interchangeable.

    A leaf may hold most documents, so its order is never one window: the digest
    deals it into about sqrt(rows) ranges, totals of ranges are summed along the
    leaf, and only a range is sorted.
    """
    columns = [c for c in docs.columns if c not in ("domain", "epoch", "n_tokens", "tokens_taken")]
    counted = docs.select(*[F.col(f"`{c}`") for c in columns], domain_of().alias("domain"), token_count(text).alias("n_tokens"))
    plan = staged(budgets(counted, recipe), "budgets")
    full = F.when(F.col("tokens") > 0, F.least(F.floor(F.col("granted") / F.col("tokens")), F.lit(recipe.max_epochs))).otherwise(0)
    plan = plan.withColumn("full_epochs", full.cast("int")).withColumn("rest", F.col("granted") - F.col("full_epochs") * F.col("tokens"))
    plan = plan.withColumn("ranges", F.ceil(F.sqrt(F.col("docs").cast("double"))))
    limits = plan.select(*[F.col(c).alias(f"__{c}") for c in LEVELS], "full_epochs", "rest", "ranges")
    same = [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in LEVELS]

    def placed(rows: DataFrame) -> DataFrame:
        """The leaf's limits and, for the epoch cut short, the digest and its range."""
        found = rows.join(limits, same).drop(*[f"__{c}" for c in LEVELS])
        digest = F.md5(F.concat_ws("|", F.lit(recipe.seed), F.col("full_epochs").cast("string"), F.coalesce(F.col(key).cast("string"), F.lit("~"))))
        fraction = F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint") / F.lit(4294967296.0)
        return found.withColumns({"__digest": digest, "__range": F.floor(fraction * F.col("ranges"))})

    # Epochs taken whole need no order.
    whole = counted.join(limits.where("full_epochs > 0"), same)
    whole = whole.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.col("full_epochs") - 1)))
    whole = whole.withColumn("tokens_taken", F.col("n_tokens"))

    slim = placed(counted.where(F.lit(True)).select(F.col(key), *LEVELS, "n_tokens")).where("rest > 0")
    sums = slim.groupBy(*LEVELS, "__range").agg(F.sum("n_tokens").alias("__sum"), F.first("rest").alias("__rest"))
    along = Window.partitionBy(*LEVELS).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.withColumn("__start", F.coalesce(F.sum("__sum").over(along), F.lit(0))).where("__start < __rest")
    starts = staged(starts.select(*[F.col(c).alias(f"__{c}") for c in LEVELS], F.col("__range").alias("__r"), "__start"), "ranges")
    inside = placed(counted).where("rest > 0").join(starts, [*same, F.col("__range") == F.col("__r")])
    ordered = Window.partitionBy(*LEVELS, "__range").orderBy("__digest", F.col(key), "n_tokens", F.md5(F.coalesce(F.col(text), F.lit(""))))
    before = F.col("__start") + F.coalesce(F.sum("n_tokens").over(ordered.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    part = inside.withColumn("__before", before).where("__before < rest")
    part = part.withColumns({"epoch": F.col("full_epochs"), "tokens_taken": F.least(F.col("n_tokens"), F.col("rest") - F.col("__before"))})
    out = [*[f"`{c}`" for c in columns], "domain", "epoch", "n_tokens", "tokens_taken"]
    return whole.select(*out).union(part.select(*out))


def op2_mixing(spark, sf_dir: str) -> DataFrame:
    mixed = mix(table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source"))
    return mixed.select("doc_id", "domain", "lang", "source", F.col("epoch").cast("int").alias("epoch"), "n_tokens", "tokens_taken")


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline: the mix by target weights."""
    return mix(docs)


def op2_sql(recipe: Recipe = PRODUCTION) -> str:
    """DuckDB SQL for op2_mixing: the budget of each node by trying every number of children taken whole."""

    def weight(level: str) -> str:
        cases = " ".join(f"WHEN {level} = '{value}' THEN {w}" for value, w in getattr(recipe, level))
        return f"CAST(CASE {cases} ELSE {recipe.default} END AS HUGEINT)"

    def level(depth: int) -> str:
        path = LEVELS[:depth]
        keys, above = ", ".join(path), path[:-1]
        source = f"(SELECT *, {weight(path[-1])} AS weight FROM (SELECT {keys}, SUM(capacity) AS capacity FROM leaves GROUP BY ALL))"
        if above:
            same = " AND ".join(f"n.{c} IS NOT DISTINCT FROM p.{c}" for c in above)
            source = f"(SELECT n.*, p.granted AS budget FROM {source} n JOIN level{depth - 1} p ON {same})"
        else:
            source = f"(SELECT *, SUM(capacity) OVER () * {recipe.budget_permille} // {1000 * recipe.max_epochs} AS budget FROM {source})"
        part = f"PARTITION BY {', '.join(above)}" if above else ""
        order = f"{part} ORDER BY capacity / weight, capacity, weight, {keys}"
        return f"""level{depth} AS (
          SELECT *, CAST(CASE WHEN whole THEN capacity ELSE weight * rest // onward_rest END AS HUGEINT) AS granted FROM (
            SELECT *, MAX(CASE WHEN NOT whole THEN onward END) OVER (w) AS onward_rest, MAX(CASE WHEN NOT whole THEN remaining END) OVER (w) AS rest FROM (
              SELECT *, capacity * onward <= weight * remaining AS whole FROM (
                SELECT *, budget - COALESCE(SUM(capacity) OVER ({order} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS remaining,
                  SUM(weight) OVER ({order} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS onward FROM {source})) WINDOW w AS ({part})))"""

    same = " AND ".join(f"c.{c} IS NOT DISTINCT FROM g.{c}" for c in LEVELS)
    named = " ".join(f"WHEN {i} THEN '{name}'" for i, name in enumerate(DOMAINS))
    return rf"""WITH counted AS (
        SELECT doc_id, text, lang, source, len(regexp_extract_all(COALESCE(text, ''), '[^\x20\x09-\x0D]+')) AS n_tokens,
          CASE TRY_CAST(NULLIF(regexp_extract(COALESCE(source, ''), '^src(\d{{1,4}})$', 1), '') AS INT) // 5 {named} ELSE 'other' END AS domain FROM documents),
      leaves AS (SELECT domain, lang, source, SUM(n_tokens) AS tokens, SUM(n_tokens) * {recipe.max_epochs} AS capacity FROM counted GROUP BY ALL),
      {level(1)}, {level(2)}, {level(3)},
      granted AS (
        SELECT l.*, CAST(CASE WHEN tokens > 0 THEN LEAST(g.granted // tokens, {recipe.max_epochs}) ELSE 0 END AS INT) AS full_epochs, g.granted
        FROM leaves l JOIN level3 g ON {same.replace("c.", "l.")}),
      joined AS (SELECT c.*, full_epochs, granted - full_epochs * tokens AS rest FROM counted c JOIN granted g ON {same}),
      ordered AS (
        SELECT *, COALESCE(SUM(n_tokens) OVER (PARTITION BY domain, lang, source ORDER BY md5(concat_ws('|', '{recipe.seed}', full_epochs, COALESCE(CAST(doc_id AS VARCHAR), '~'))),
          doc_id, n_tokens, md5(COALESCE(text, '')) ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM joined)
      SELECT doc_id, domain, lang, source, CAST(e.epoch AS INT) AS epoch, CAST(n_tokens AS BIGINT) AS n_tokens, CAST(n_tokens AS BIGINT) AS tokens_taken
      FROM joined JOIN (SELECT UNNEST(range({recipe.max_epochs})) AS epoch) e ON e.epoch < full_epochs
      UNION ALL
      SELECT doc_id, domain, lang, source, full_epochs, CAST(n_tokens AS BIGINT), CAST(LEAST(n_tokens, rest - before) AS BIGINT) FROM ordered WHERE before < rest"""
