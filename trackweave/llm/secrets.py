"""Secret scan with corpus-wide ownership frequency: DataFrame functions only.

Candidates are found by pattern in every text. Their hashes are counted by distinct owners and distinct repositories
over the whole corpus: a value that many owners or repositories hold is a widely copied example, one that a single
owner holds in few repositories and that looks random is live-looking. Live-looking values found bare, outside the
base patterns, add spans of kind owned.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trackweave.llm.common import materialize, salted_join

# Fixed values of the contract: the base patterns (Java syntax), and what a match must have.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{14,}"  # the runs of AKIA[A-Z0-9]+ that have 18 characters
HEX = r"[0-9a-f]{16,}"  # the runs of [0-9a-f]+ that have 16 characters
ASSIGN_LEAST = 12
KINDS = ("assign", "access", "hex", "owned")

#: Bare candidates: runs of 20 characters or more; only those with a digit count.
BARE = r"[A-Za-z0-9+/_-]{20,}"
#: From this many owners or repositories on, a value is an example that many have copied.
EXAMPLE_OWNERS, EXAMPLE_REPOS = 3, 4
#: A live-looking value has at least so many different characters.
LIVE_CHARACTERS = 10


def _pieces(text: Column, pattern: str, kind: int, value_group: int = 0) -> Column:
    """Array of (kind, gap, len, value) of the pattern's matches, leftmost and non-overlapping: the characters between
    a match and the one before, and its own."""
    found, gaps = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(value_group))
    zipped = F.arrays_zip(F.transform(gaps, F.length).alias("gap"), F.transform(found, F.length).alias("len"), values.alias("value"))
    pieces = F.transform(F.filter(zipped, lambda x: x["len"].isNotNull()), lambda x: F.struct(F.lit(kind).alias("kind"), x["gap"].alias("gap"), x["len"].alias("len"), x["value"].alias("value")))
    return F.when(text.rlike(pattern), pieces).otherwise(F.expr("cast(array() as array<struct<kind:int,gap:int,len:int,value:string>>)"))


def _looks_live(value: Column) -> Column:
    return value.rlike("[0-9]") & value.rlike("[A-Za-z]") & (F.size(F.array_distinct(F.split(value, ""))) >= LIVE_CHARACTERS)


def candidates(docs: DataFrame, ident: str, text: str, owner: Column, repo: Column) -> DataFrame:
    """A row for each text: row, id, owner, repo, pieces (of all kinds, in order for each)."""
    whole = F.coalesce(F.col(text), F.lit(""))
    pieces = F.concat(_pieces(whole, ASSIGN, 0, 2), _pieces(whole, ACCESS, 1), _pieces(whole, HEX, 2), _pieces(whole, BARE, 3))
    return docs.select(F.monotonically_increasing_id().alias("row"), F.col(ident).alias("id"), F.coalesce(owner.cast("string"), F.lit("")).alias("owner"), F.coalesce(repo.cast("string"), F.lit("")).alias("repo"), pieces.alias("pieces"))


def located(found: DataFrame) -> DataFrame:
    """(row, owner, repo, kind, start, stop, value): the base spans, and the bare ones clear of them, in code points.

    A place is the sum of the gaps and matches up to it; whether a bare span meets a base one is told by the furthest
    end of those that start before it and the first start of those after. Work is in proportion to the matches.
    """
    rows = found.select("row", "owner", "repo", F.posexplode("pieces").alias("k", "p"))
    up_to = F.sum(F.col("p.gap") + F.col("p.len")).over(Window.partitionBy("row", "p.kind").orderBy("k"))
    spans = rows.select("row", "owner", "repo", F.col("p.kind").alias("kind"), (up_to - F.col("p.len")).cast("int").alias("start"), up_to.cast("int").alias("stop"), F.col("p.value").alias("value"))
    spans = spans.where(f"not (kind = 0 and length(value) < {ASSIGN_LEAST}) and not (kind = 3 and not rlike(value, '[0-9]'))")
    base, text = F.col("kind") < 3, Window.partitionBy("row")
    so_far = (Window.unboundedPreceding, 0)  # a frame that only grows, so each row is looked at once
    ended = F.max(F.when(base, F.col("stop"))).over(text.orderBy("start").rangeBetween(*so_far))
    starts = F.min(F.when(base, F.col("start"))).over(text.orderBy(F.desc("start")).rangeBetween(*so_far))
    meets = F.coalesce(ended > F.col("start"), F.lit(False)) | F.coalesce(starts < F.col("stop"), F.lit(False))
    return spans.withColumn("meets", meets).where(base | ~F.col("meets")).drop("meets")


def ownership(spans: DataFrame) -> DataFrame:
    """(value_hash, n_owners, n_repos): distinct owners and repositories of each candidate value in the corpus."""
    by_repo = spans.groupBy("value_hash", "owner", "repo").agg(F.lit(1).alias("one"))
    by_owner = by_repo.groupBy("value_hash", "owner").agg(F.count("one").alias("repos"))
    return by_owner.groupBy("value_hash").agg(F.count("repos").alias("n_owners"), F.sum("repos").alias("n_repos"))


def _listed(spans: Column) -> Column:
    """kind:start:stop of spans (start, kind, stop), comma-joined in that order."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat(F.element_at(names, s["kind"] + 1), F.lit(":"), s["start"].cast("string"), F.lit(":"), s["stop"].cast("string"))), ",")


def secret_scan(docs: DataFrame, ident: str = "doc_id", text: str = "text", owner: Column | None = None, repo: Column | None = None) -> DataFrame:
    """A row for each row of ``docs``: ident, counts by kind, all spans, and what the corpus says about them.

    Columns: n_assign, n_access, n_hex, base_sha256, spans (kind:start:end, code points, end exclusive), n_owned,
    n_live and n_example: base spans whose value looks random and belongs to one owner, in fewer than EXAMPLE_REPOS
    repositories; and those whose value EXAMPLE_OWNERS owners or EXAMPLE_REPOS repositories hold. Owner is the column
    source and repository its part in one language, unless other columns are given.

    Null text: as the empty text, no spans. Null id, owner or repository: passes; a null owner is one owner. Rows
    that repeat: a result each. Kinds that start at one place are listed in the order of KINDS. Texts may be of any
    length and have any number of matches. Empty table: no rows. Other columns play no part.
    """
    owner = F.col("source") if owner is None else owner
    repo = F.concat_ws("/", F.col("source"), F.col("lang")) if repo is None else repo
    found = materialize(candidates(docs, ident, text, owner, repo), "secret-candidates")
    spans = materialize(located(found).withColumn("value_hash", F.xxhash64("value")), "secret-spans")
    many = (F.col("n_owners") >= EXAMPLE_OWNERS) | (F.col("n_repos") >= EXAMPLE_REPOS)
    live = (F.col("n_owners") == 1) & ~many & _looks_live(F.col("value"))
    judged = salted_join(spans, ownership(spans).hint("shuffle_hash"), ["value_hash"], by=F.col("row")).select("row", "kind", F.struct("start", "kind", "stop").alias("s"), live.alias("live"), many.alias("example"))
    base = F.col("kind") < 3
    count = lambda k: F.count_if(F.col("kind") == k)
    each = judged.groupBy("row").agg(
        F.collect_list(F.when(base, F.col("s"))).alias("base"), F.collect_list(F.when(base | F.col("live"), F.col("s"))).alias("every"), count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        F.count_if(F.col("live") & ~base).alias("n_owned"), F.count_if(F.col("live") & base).alias("n_live"), F.count_if(F.col("example") & base).alias("n_example"),
    )
    out = found.select("row", "id").join(each.hint("shuffle_hash"), "row", "left")
    n = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    listed = lambda c: F.coalesce(_listed(F.col(c)), F.lit(""))
    return out.select(F.col("id").alias(ident), *map(n, ("n_assign", "n_access", "n_hex")), F.sha2(listed("base"), 256).alias("base_sha256"), listed("every").alias("spans"), *map(n, ("n_owned", "n_live", "n_example")))
