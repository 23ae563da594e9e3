"""Record linkage: blocking, scoring, one-to-one assignment, and best-match lookups."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import config, session
from ..functions import fuzzy, match, text
from . import aggregate, assign

#: Rows and bytes of a query set that are broadcast at once.
BLOCK_ROWS, BLOCK_BYTES = 100_000, 64 << 20
#: Pairs that a task makes of the rows dealt to it.
PART_PAIRS = 5_000_000
#: About so many left rows of a class are sorted as a list, and so many right rows of a class are a piece.
LIST_ROWS, RUN_ROWS = 32, 128


def block_key(name: Column, size: int = 4, prefixes: Sequence[str] = config.COMPANY_PREFIXES, suffixes: Sequence[str] = config.COMPANY_SUFFIXES) -> Column:
    """The first characters of a normalised name without region and company words, removed in order."""
    key = text.normalize(name)
    for word in [*prefixes, *suffixes]:
        key = F.replace(key, F.lit(word))
    return F.substring(key, 1, size)


def candidates(left: DataFrame, right: DataFrame, key: str, fallback: bool = True, alike: tuple[str, str, float] | None = None) -> DataFrame:
    """Rows of the same block; a left row whose block has no right row meets every right row, as the
    semantics want, or, with ``alike`` (both names' columns and the least similarity that the caller
    keeps), every right row of a name so similar, without a product. Without ``fallback`` such rows
    meet none. Columns of the two sides must differ but for the key."""
    same = left.join(right, key)
    if not fallback:
        return same
    alone = left.join(right.select(key).distinct(), key, "left_anti")
    if alike is None:
        return same.unionByName(alone.crossJoin(right.drop(key)))
    a, b, least = alike
    names = similar_names(alone.select(a), right.select(b), a, b, least)
    names = names.select(F.col(a).alias("__a"), F.col(b).alias("__b"))
    met = alone.join(names, F.col(a) == F.col("__a")).join(right.drop(key), F.col("__b") == F.col(b))
    return same.unionByName(met.drop("__a", "__b"))


def candidate_blocks(left: DataFrame, right: DataFrame, key: str, mine: Sequence[Column], theirs: Sequence[Column], fallback: bool = True) -> DataFrame:
    """A row for each block of ``candidates`` without making its pairs: their number ``n``, and aggregates of the left and the right
    rows that repeats don't change (least, greatest). Both sides are summed by block before they meet."""
    each = left.groupBy(key).agg(F.count("*").alias("__mine"), *mine)
    others = right.groupBy(key).agg(F.count("*").alias("__theirs"), *theirs)
    met = each.join(others, key)
    if fallback:
        whole = right.agg(F.count("*").alias("__theirs"), *theirs)
        met = met.unionByName(each.join(others.select(key), key, "left_anti").crossJoin(F.broadcast(whole)).where(F.col("__theirs") > 0))
    return met.withColumn("n", F.col("__mine") * F.col("__theirs")).drop("__mine", "__theirs")


def best_by_class(left: DataFrame, right: DataFrame, key: str, mine: str, theirs: str, score: Column, tie: str) -> DataFrame:
    """Left rows with the highest score, ``best_score``, of the right rows of their block, and the smallest ``tie`` of equals, where
    ``score`` depends on the classes ``mine`` and ``theirs`` alone: a class's rows stand for one another, so that only classes are
    paired. A block has as many pairs as classes times classes, however many rows; they are counted twice and never stored."""
    held = right.groupBy(key, theirs).agg(F.min(tie).alias(tie))
    spread = left.sparkSession.sparkContext.defaultParallelism
    pairs = left.select(key, mine).distinct().repartition(spread, key, mine).join(held, key).withColumn("best_score", score)
    most = pairs.groupBy(key, mine).agg(F.max("best_score").alias("__most")).hint("shuffle_hash")  # dealt as the pairs are
    best = pairs.join(most, [key, mine]).where("best_score = __most").groupBy(key, mine, "best_score").agg(F.min(tie).alias(tie))
    return left.join(best, [key, mine])


def scored_by_class(left: DataFrame, right: DataFrame, key: str, mine: str, theirs: str, scores: DataFrame, part: int = PART_PAIRS) -> DataFrame:
    """Every pair of a block with the score of its classes (``scores``: the two classes and their columns; a small table). Left rows
    are dealt to tasks of about ``part`` pairs by the pairs of the classes before theirs, whatever the blocks' sizes, and stream
    past the right rows, which are broadcast a counted block at a time; no pair is shuffled. Within a task pairs come a piece of a
    right class at a time: a left row stays the same along the piece, which comes again for the next left row, so that a columnar
    file of all pairs takes a fraction of a byte a pair. Left rows are sorted for that as short lists, and then are rows again."""
    held = blocks(right, *right.columns)
    n = left.groupBy(key, mine).agg(F.count("*").alias("__n")).join(right.groupBy(key).agg(F.count("*").alias("__m")), key)
    n = aggregate.before(n.withColumn("__pairs", F.col("__n") * F.col("__m")).drop("__m"), [], [F.col(key), F.col(mine)], "__pairs", "__before")
    total, classes = n.agg(F.coalesce(F.sum("__pairs"), F.lit(0)), F.count("*")).first()
    tasks = max(1, -(-total // (part * len(held))))
    rows = left.withColumn("__id", F.xxhash64(F.monotonically_increasing_id())).join(F.broadcast(n) if classes <= BLOCK_ROWS else n, [key, mine])
    rows = rows.withColumn("__lists", F.ceil(F.col("__n") / LIST_ROWS)).withColumn("__list", F.pmod("__id", "__lists"))
    at = F.floor((F.col("__before") + F.col("__list") * (F.col("__pairs") / F.col("__lists"))) / max(1, total) * tasks)
    kept = F.struct(*[c for c in left.columns if c not in (key, mine)])
    rows = rows.select(key, mine, "__list", F.least(at, F.lit(tasks - 1)).cast("int").alias("__at"), kept.alias("__row")).repartitionById(tasks, F.col("__at"))
    lists = rows.groupBy("__at", key, mine, "__list").agg(F.collect_list("__row").alias("__rows")).drop("__at", "__list").join(F.broadcast(scores), mine)

    def paired(block: DataFrame) -> DataFrame:
        wide = F.broadcast(block.groupBy(key, theirs).agg(F.ceil(F.count("*") / RUN_ROWS).alias("__pieces")))
        pieces = block.withColumn("__id", F.xxhash64(F.monotonically_increasing_id())).join(wide, [key, theirs]).withColumn("__piece", F.pmod("__id", "__pieces").cast("smallint"))
        met = lists.join(wide, [key, theirs]).withColumn("__piece", F.explode(F.sequence(F.lit(0).cast("smallint"), (F.col("__pieces") - 1).cast("smallint")))).drop("__pieces")
        met = met.sortWithinPartitions(key, theirs, "__piece", mine).select("*", F.inline("__rows")).drop("__rows")
        return met.join(F.broadcast(pieces.drop("__id", "__pieces")), [key, theirs, "__piece"]).drop("__piece")

    return reduce(DataFrame.unionByName, [paired(block) for block in held])


def similar_names(left: DataFrame, right: DataFrame, a: str, b: str, least: float, form: Callable[[Column], Column] = text.normalize, measure: Callable[[Column, Column], Column] = fuzzy.similarity) -> DataFrame:
    """Distinct pairs of names whose ``measure`` is from ``least`` (over 0). Such names share, counting
    repeats, a least/(200 - least) of the shorter one's characters, so that one of the shorter's rarest
    characters is among the other's: only names that meet there are compared. Null and empty names
    have no pair; characters are those that ``form``, which the measure applies too, leaves of a name."""

    def named(frame: DataFrame, name: str) -> DataFrame:
        return frame.select(F.col(name).alias("name")).distinct().withColumn("told", form(F.col("name"))).withColumn("n", F.length("told")).where("n > 0")

    def characters(names: DataFrame) -> DataFrame:
        each = names.select("name", "n", F.explode(F.transform(F.sequence(F.lit(1), F.col("n")), lambda i: F.substring("told", i, F.lit(1)))).alias("c"))
        return each.groupBy("name", "n", "c").agg(F.count("*").cast("int").alias("times")).select("name", "n", F.explode(F.transform(F.sequence(F.lit(1), F.col("times")), lambda k: F.struct("c", k.alias("k")))).alias("c"))

    sides = [session.checkpointed(characters(named(frame, name))) for frame, name in ((left, a), (right, b))]
    common = sides[0].select("c").union(sides[1].select("c")).groupBy("c").agg(F.count("*").alias("held"))
    rank = F.row_number().over(Window.partitionBy("name").orderBy("held", "c"))
    rarest = lambda side: side.join(common, "c").withColumn("rank", rank).where(F.col("rank") <= F.col("n") - F.ceil(F.col("n") * least / (200 - least) - 1e-9) + 1)
    told = lambda side, to: side.select("c", F.col("name").alias(to), F.col("n").alias(f"n_{to}"))
    mine, theirs = (told(side, to) for side, to in zip(sides, ("__l", "__r"), strict=True))
    met = told(rarest(sides[0]), "__l").join(theirs, "c").where("n___l <= n___r").select("__l", "__r")
    met = met.union(told(rarest(sides[1]), "__r").join(mine, "c").where("n___r < n___l").select("__l", "__r")).distinct()
    return met.where(measure(F.col("__l"), F.col("__r")) >= least).select(F.col("__l").alias(a), F.col("__r").alias(b))


def equal_or_unknown(a: Column, b: Column) -> Column:
    """50 if either is empty, 100 if equal, else 0."""
    empty = (text.default(a) == "") | (text.default(b) == "")
    return F.when(empty, 50.0).when(F.trim(a) == F.trim(b), 100.0).otherwise(0.0)


def equal_text(a: Column, b: Column) -> Column:
    """100 or 0; two empty values are equal."""
    return F.when(F.trim(F.coalesce(a, F.lit(""))) == F.trim(F.coalesce(b, F.lit(""))), 100.0).otherwise(0.0)


def order_valid(report_year: Column, approval_date: Column) -> Column:
    """50 if a year is missing, 100 if the report's is not later, else 0."""
    a, b = F.substring(report_year, 1, 4).try_cast("int"), F.substring(approval_date, 1, 4).try_cast("int")
    return F.when(a.isNull() | b.isNull(), 50.0).when(a <= b, 100.0).otherwise(0.0)


def scored(pairs: DataFrame, matching: config.Matching = config.Matching()) -> DataFrame:
    """Candidate pairs with similarities, match_score and the reasons to reject. Rows need report_ and
    approval_ company, project, type, project_type, town, kind, and year, date, title, evidence."""
    c = F.col
    rows = pairs.withColumn("company_similarity", fuzzy.similarity(c("report_company"), c("approval_company")))
    rows = rows.withColumn("project_similarity", fuzzy.similarity(c("report_project"), c("approval_project")))
    known = [text.default(c(n)) != "" for n in ("report_company", "approval_company", "report_project", "approval_project")]
    rows = rows.where(known[0] & known[1] & known[2] & known[3] & (c("company_similarity") >= matching.least_company) & (c("project_similarity") >= matching.least_project))
    rows = rows.withColumn("report_type_match", equal_or_unknown(c("report_type"), c("approval_type"))).withColumn("project_type_match", equal_or_unknown(c("report_project_type"), c("approval_project_type")))
    rows = rows.withColumn("town_match", equal_or_unknown(c("report_town"), c("approval_town"))).withColumn("date_order_valid", order_valid(c("report_year"), c("approval_date")))
    w = matching.weights
    score = c("company_similarity") * w["company"] + c("project_similarity") * w["project"] + c("report_type_match") * w["report_type"] + c("project_type_match") * w["project_type"] + c("town_match") * w["town"] + c("date_order_valid") * w["date"]
    blob = F.concat(*[F.coalesce(c(n), F.lit("")) for n in ("approval_title", "approval_evidence", "approval_project")])
    both = (text.default(c("report_type")) != "") & (text.default(c("approval_type")) != "")
    rejects = match.reasons([
        (c("report_kind") != "report", "report_detected_file_type_not_report"),
        (c("approval_kind") != "approval", "approval_detected_file_type_not_approval"),
        (c("company_similarity") < matching.strict_company, "company_not_strict_match"),
        (c("project_similarity") < matching.strict_project, "project_name_not_strict_match"),
        (both & (c("report_type") != c("approval_type")), "report_type_mismatch"),
        ((text.default(c("report_project_type")) != "") & ~F.contains(blob, c("report_project_type")), "project_type_not_found_in_approval"),
    ])
    return rows.withColumn("match_score", score).withColumn("rejects", rejects)


def assigned(pairs: DataFrame, left: str, right: str, order: Sequence[Column], matching: config.Matching = config.Matching()) -> DataFrame:
    """pair_status: clean pairs one to one; other pairs stay as review or mismatch unless an end was
    consumed by a clean pair that comes before them. ``order`` ends with unique ids."""
    ranked = session.checkpointed(pairs.withColumn("__rank", F.struct(-F.col("match_score"), *order)))
    eligible = (F.col("match_score") >= matching.clean) & (F.size("rejects") == 0)
    clean = assign.one_to_one(ranked.where(eligible), left, right, [F.col("__rank")])
    mark = lambda key: clean.select(F.col(key), F.col("__rank").alias(f"__{key}"))
    rest = ranked.join(clean.select(left, right), [left, right], "left_anti").join(mark(left), left, "left").join(mark(right), right, "left")
    free = lambda key: F.col(f"__{key}").isNull() | (F.col("__rank") < F.col(f"__{key}"))
    rest = rest.where(free(left) & free(right)).where(~eligible)
    rest = rest.withColumn("pair_status", F.when(F.col("match_score") >= matching.review, "candidate").otherwise("mismatch")).drop(f"__{left}", f"__{right}")
    return clean.withColumn("pair_status", F.lit("clean")).unionByName(rest).drop("__rank")


def unmatched(frame: DataFrame, pairs: DataFrame, key: str) -> DataFrame:
    return frame.join(pairs.select(key).distinct(), key, "left_anti")


def best_right(pairs: DataFrame, left: Sequence[str], score: Column, tie: Column) -> DataFrame:
    """For each left key the pair with the highest score, the smallest tie value of equals."""
    rows = pairs.withColumn("__score", score).withColumn("__tie", tie)
    columns = [c for c in pairs.columns if c not in left]
    best = rows.groupBy(*left).agg(F.max_by(F.struct(*columns), F.struct(F.col("__score"), -F.col("__tie"))).alias("b"), F.max("__score").alias("best_score"))
    return best.select(*left, "b.*", "best_score")


def blocks(frame: DataFrame, *sized: str, rows: int = BLOCK_ROWS, size: int = BLOCK_BYTES) -> list[DataFrame]:
    """A query set in blocks that are small enough to broadcast: counted rows, and counted bytes of the
    ``sized`` columns. Most sets are one block."""
    held = session.checkpointed(frame.withColumn("__n", F.monotonically_increasing_id()))
    total = sum((F.coalesce(F.octet_length(F.col(c).cast("string")), F.lit(0)) for c in sized), F.lit(0).cast("long"))
    n, told = held.agg(F.count("*"), F.coalesce(F.sum(total), F.lit(0))).first()
    k = max(1, -(-n // rows), -(-told // size))
    return [held.where(F.col("__n") % k == i).drop("__n") for i in range(k)]


def by_certainty(left: DataFrame, right: DataFrame, ways: Sequence[tuple[Column, Column, float]], left_key: str, order: str, loose: Column | None = None) -> DataFrame:
    """Left rows with the best right row by several keys of falling certainty: each way is an equi-join
    on two expressions with a fixed score; ``loose`` scores what is left against the right side, an index
    of files, a block at a time. The highest score wins, then the first in order."""
    found, out = None, left
    for mine, theirs, score in ways:
        hit = out.withColumn("__k", mine).where("__k is not null and __k != ''").join(right.withColumn("__k", theirs), "__k").drop("__k").withColumn("score", F.lit(float(score)))
        found = hit if found is None else found.unionByName(hit)
    best = best_right(found, [left_key], F.col("score"), F.col(order))
    if loose is None:
        return best
    rest = left.join(best.select(left_key), left_key, "left_anti")
    met = [rest.crossJoin(F.broadcast(block)).withColumn("score", loose).where("score > 0") for block in blocks(right, *right.columns)]
    return best.unionByName(best_right(reduce(DataFrame.unionByName, met), [left_key], F.col("score"), F.col(order)), allowMissingColumns=True)


def title_lookup(left: DataFrame, right: DataFrame, left_title: str, right_title: str, order: str, core: int = 10) -> DataFrame:
    """Equal titles without white space; else the first right row of which one side's core (its first
    characters) holds in the other. ``m`` is the right row, ``how`` equal, contained or none. Only left
    rows without an equal title meet the second way: by equality of a core with any run of ``core``
    characters of the other side, of which the first right row alone is kept, so that no row meets
    many. Null titles find none; repeated left rows stay."""
    rows = left.withColumn("__l", text.compact(F.col(left_title)))
    held = right.select(text.compact(F.col(right_title)).alias("__t"), F.struct(*right.columns).alias("__m"), F.col(order).alias("__o"))
    first = lambda frame, key: frame.groupBy(key).agg(F.min_by("__m", "__o").alias("__m"), F.min("__o").alias("__o"))
    equal = rows.join(first(held, "__t").select("__t", F.col("__m").alias("m")), F.col("__l") == F.col("__t"), "left").drop("__t")
    found = equal.where("m is not null").withColumn("how", F.lit("equal"))
    rest = equal.where("m is null").drop("m")
    head = lambda frame, x: frame.where(F.length(x) >= core).withColumn("__g", F.substring(x, 1, core))
    runs = lambda x: F.transform(F.sequence(F.lit(1), F.greatest(F.length(x) - core + 1, F.lit(1))), lambda i: F.substring(x, i, F.lit(core)))
    inner = lambda frame, x: frame.where(F.length(x) >= core).withColumn("__g", F.explode(F.array_distinct(runs(x))))
    titles = rest.select("__l").distinct()
    hit = head(titles, "__l").join(first(inner(held, "__t"), "__g"), "__g").unionByName(inner(titles, "__l").join(first(head(held, "__t"), "__g"), "__g"))
    hit = rest.join(first(hit, "__l").select("__l", F.col("__m").alias("m")), "__l", "left")
    hit = hit.withColumn("how", F.when(F.col("m").isNotNull(), "contained").otherwise("none"))
    return found.select(*left.columns, "m", "how").unionByName(hit.select(*left.columns, "m", "how"))


def containing(texts: DataFrame, x: str, needles: DataFrame, needle: str) -> DataFrame:
    """Rows of texts that hold a needle, with the needle's row. A needle's longest inner word stands
    between blanks wherever the needle does, so texts meet only needles whose word they have; needles
    without an inner word meet all texts. The needles are a query set, broadcast in counted blocks."""
    words = F.split(needle, " ")
    inner = F.filter(F.slice(words, 2, F.greatest(F.size(words) - 2, F.lit(0))), lambda w: w != "")
    held = needles.withColumn("__key", F.array_max(F.transform(inner, lambda w: F.struct(F.length(w).alias("n"), w.alias("w"))))["w"])
    out = []
    for block in blocks(held, needle):
        keyed = block.where("__key is not null")
        keys = keyed.agg(F.collect_set("__key").alias("__keys"))
        found = texts.crossJoin(F.broadcast(keys)).withColumn("__key", F.explode(F.array_intersect(F.split(x, " "), "__keys"))).drop("__keys")
        out.append(found.join(F.broadcast(keyed), "__key").where(F.contains(x, F.col(needle))).drop("__key"))
        out.append(texts.join(F.broadcast(block.where("__key is null").drop("__key")), F.contains(x, F.col(needle))))
    return reduce(DataFrame.unionByName, out)


def last_by(frame: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """One row a key, the last in order: what a dictionary filled in that order holds."""
    columns = [c for c in frame.columns if c != key]
    return frame.groupBy(key).agg(F.max_by(F.struct(*columns), F.struct(*order)).alias("r")).select(key, "r.*")


def region_paths(regions: DataFrame, by: str = "/", most: int = 1_000) -> DataFrame:
    """code and the names from the root down, by a recursive walk from the roots (rows without a parent, or whose parent
    isn't there), however deep, up to ``most`` levels. Codes on a cycle, or below one, have no root: their path is the walk
    upwards until a code comes again. Codes are unique."""
    spark, name = regions.sparkSession, f"regions_{uuid.uuid4().hex}"
    held = session.checkpointed(regions.select("code", "name", "parent_code"))
    held.createOrReplaceTempView(name)
    down = spark.sql(f"""with recursive walk(code, names) max recursion level {most} as (
  select r.code, array(r.name) from {name} r left anti join {name} u on r.parent_code = u.code
  union all select r.code, concat(w.names, array(r.name)) from walk w join {name} r on r.parent_code = w.code
) select code, names from walk""")
    down = session.checkpointed(down)
    held.join(down, "code", "left_anti").createOrReplaceTempView(f"{name}_loops")
    up = spark.sql(f"""with recursive walk(code, names, seen, next_code) max recursion level {most} as (
  select code, array(name), array(code), parent_code from {name}_loops
  union all select w.code, concat(array(r.name), w.names), concat(w.seen, array(r.code)), r.parent_code from walk w join {name} r on r.code = w.next_code where not array_contains(w.seen, r.code)
) select code, max_by(names, size(names)) as names from walk group by code""")
    return down.unionByName(up).select("code", F.array_join("names", by).alias("path"))
