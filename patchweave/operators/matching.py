"""Matching: which installed packages does which advisory affect?

inventory: package_id, ecosystem, name, version, source_name, source_version, module_stream (all but the first string).
affected: database, advisory_id, aff_ord, ecosystem, name, ranges, versions, module_stream, an entry per row.

Packages and ranges meet in a sweep over key ranges (operators/sweep.py), listed versions in an equi-join on keys, and
ranges that can't be read in one on names, as they concern every version; what needs both sides at once (versions
without a key, module streams, branches) is compared pair by pair. Outcomes are data: a hit, a miss or an error with
its cause, so that what could not be checked never looks clean.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from patchweave.functions import names as N
from patchweave.functions import versions as V
from patchweave.operators import ranges as R
from patchweave.operators.components import components
from patchweave.operators.sweep import first_intervals, interval_join
from patchweave.tables import drop_table, write_table

RANGES = f"array<struct<type:string,events:{R.EVENTS},fix_state:string>>"
#: range_ord of the list of single versions, which comes after all ranges.
LISTED = 1_000_000
#: Builds of maintenance lines that the databases don't describe.
_UBUNTU_LINE = r"(?i)[~+](esm|fips)[0-9]"
_ORACLE_LINE = r"(?i)\.ksplice[0-9]+\.|_fips$"
#: Most rows that are broadcast.
SMALL = 100_000


def small(df: DataFrame) -> DataFrame:
    """df, broadcast only where it is counted to be small."""
    return F.broadcast(df) if df.limit(SMALL + 1).count() <= SMALL else df


def skip_reason(coverage: Column) -> Column:
    """Why a package can't be checked as a whole, null if it can; coverage: whether its ecosystem is in the database.
    The first reason that holds counts."""
    e, v = F.col("ecosystem"), F.col("version")
    return (
        F.when(V.comparer_of(e).isNull(), "no version ordering for the ecosystem")
        .when(~coverage, "the database does not cover the ecosystem")
        .when(v.rlike(_UBUNTU_LINE), "a build of a separate maintenance line")
        .when(e.startswith("Oracle Linux:") & v.rlike(_ORACLE_LINE), "a build of a separate maintenance line")
        .when(v.rlike(r"module\+el|module_el") & (F.coalesce("module_stream", F.lit("")) == ""), "a module build of an unknown stream")
    )


def guard(inventory: DataFrame, ecosystems: DataFrame) -> DataFrame:
    """inventory with skip_reason; ecosystems: the covered ones."""
    known = small(ecosystems.select(F.col("ecosystem").alias("__covered")).distinct())
    joined = inventory.join(known, inventory.ecosystem == F.col("__covered"), "left")
    return joined.withColumn("skip_reason", skip_reason(F.col("__covered").isNotNull())).drop("__covered")


def lookup_names(inventory: DataFrame) -> DataFrame:
    """A row per name by which a package is looked up: its own, then its source's with the source's version."""
    own = F.struct(F.lit(0).alias("name_ord"), F.col("name").alias("lookup"), F.col("version").alias("compared"))
    source = F.when((F.col("source_name") != "") & (F.col("source_name") != F.col("name")), F.struct(F.lit(1).alias("name_ord"), F.col("source_name").alias("lookup"), F.coalesce(F.nullif("source_version", F.lit("")), "version").alias("compared")))
    rows = inventory.withColumn("__n", F.explode(F.array_compact(F.array(own, source))))
    return rows.select("*", "__n.*").drop("__n").withColumn("norm_name", N.normalize_name(F.col("ecosystem"), F.col("lookup")))


def module_state(stream: Column, entry_stream: Column, comparer: Column, tagged: Column) -> Column:
    """'skip' where the streams rule the entry out, 'cut' where both are equal (module tails are then cut off), 'error'
    where a module build's bound (tagged) meets a package without a stream, else 'plain'."""
    s, e = F.coalesce(stream, F.lit("")), F.coalesce(entry_stream, F.lit(""))
    return F.when((e != "") & (e != s), "skip").when((s != "") & (e == "") & ~tagged, "skip").when((s != "") & (e == s), "cut").when((comparer == "rpm") & tagged, "error").otherwise("plain")


def cut_module(version: Column) -> Column:
    return F.regexp_replace(version, r"\.module[+_]el.*$", "")


_TAIL = r"\.module[+_]el"


def _keys(rows: DataFrame, versions: str) -> DataFrame:
    """rows with __k: the keys of a column of version arrays by the ordering that the column comparer names."""
    by_python = F.col("comparer").isin(*V.PYTHON)
    return rows.withColumn("__k", F.when(by_python, V.python_keys("comparer", F.when(by_python, F.col(versions)))).otherwise(R.native_keys(None, versions)))


def key_table(rows: DataFrame, versions: Column) -> DataFrame | None:
    """comparer, v, k: a key for each distinct version of rows (comparer, and an array of versions), to be broadcast; None
    where there are more than SMALL of them. Installed versions repeat: of many packages few versions are different."""
    each = rows.select("comparer", F.explode(versions).alias("v")).filter("comparer is not null and v is not null").distinct()
    held = write_table(each.limit(SMALL + 1), "match-versions")
    if held.count() > SMALL:
        return None
    return F.broadcast(_keys(held.withColumn("__v", F.array("v")), "__v").select("comparer", "v", F.get("__k", F.lit(0)).alias("k")))


def _keyed_names(inventory: DataFrame) -> DataFrame:
    """A row per package and lookup name, with the key of its version, whole (vk) and without a module's tail (ck);
    lookups: how many names it is looked up by, 0 where they are two that read alike."""
    own = F.col("compared")
    tailed, both = own.rlike(_TAIL), F.when(own.rlike(_TAIL), F.array(own, cut_module(own))).otherwise(F.array(own))
    rows = lookup_names(inventory).withColumn("comparer", V.comparer_of("ecosystem"))
    table = key_table(rows, both)
    if table is None:
        keyed = _keys(rows.withColumn("__v", both), "__v").withColumns({"vk": F.get("__k", F.lit(0)), "ck": F.get("__k", F.size("__v") - 1)})
    else:
        whole = rows.join(table.select("comparer", F.col("v").alias("compared"), F.col("k").alias("vk")), ["comparer", "compared"], "left").withColumn("__cut", F.when(tailed, cut_module(own)))
        keyed = whole.join(table.select("comparer", F.col("v").alias("__cut"), F.col("k").alias("__ck")), ["comparer", "__cut"], "left").withColumn("ck", F.when(F.col("__cut").isNotNull(), F.col("__ck")).otherwise(F.col("vk")))
    source, own = N.normalize_name(F.col("ecosystem"), F.col("source_name")), N.normalize_name(F.col("ecosystem"), F.col("name"))
    lookups = F.when(F.coalesce(F.col("source_name"), F.lit("")).isin("") | (F.col("source_name") == F.col("name")), 1).when(source == own, 0).otherwise(2)
    return keyed.select("package_id", "ecosystem", "norm_name", "name_ord", "compared", "module_stream", "vk", "ck", lookups.alias("lookups"))


def _keyed_ranges(affected: DataFrame) -> DataFrame:
    """A row per range of an entry, and one for its list of versions, with sorted events and keys, each whole and
    without module tails: all that depends on the advisory alone is worked out before the join."""
    no = F.array().cast("array<string>")
    tagged = F.expr("exists(ranges, r -> exists(r.events, e -> concat_ws(' ', e.introduced, e.fixed, e.last_affected, e.limit) rlike 'module[+_]el'))")
    rows = affected.withColumns({"norm_name": N.normalize_name(F.col("ecosystem"), F.col("name")), "comparer": V.comparer_of("ecosystem"), "entry_stream": F.col("module_stream"), "tagged": F.coalesce(tagged, F.lit(False))})
    blank = F.expr("named_struct('type', 'LIST', 'events', cast(null as " + R.EVENTS + "), 'fix_state', cast(null as string))")
    some = F.size(F.coalesce("versions", no)) > 0
    listed = F.when(some, F.array(F.struct(F.lit(LISTED).alias("pos"), blank.alias("col")))).otherwise(F.array().cast(f"array<struct<pos:int,col:struct<type:string,events:{R.EVENTS},fix_state:string>>>"))
    numbered = F.transform(F.coalesce("ranges", F.array().cast(RANGES)), lambda r, i: F.struct(i.alias("pos"), r.alias("col")))
    each = rows.withColumn("__r", F.explode(F.concat(numbered, listed))).select(
        "ecosystem", "norm_name", "comparer", "database", "advisory_id", "aff_ord", "entry_stream", "tagged", F.col("__r.pos").alias("range_ord"), F.col("__r.col.type").alias("range_type"), F.col("__r.col.events").alias("events"), F.col("__r.col.fix_state").alias("fix_state"),
        F.when(F.col("__r.pos") == LISTED, F.coalesce("versions", no)).otherwise(no).alias("versions"),
    )
    each = each.withColumn("__b", R.bounds("events")).withColumn("__own", F.concat("__b", "versions")).withColumn("__tails", F.exists("__own", lambda x: x.rlike(_TAIL)))
    each = each.withColumn("__all", F.concat("__own", F.when(F.coalesce("__tails", F.lit(False)), F.transform("__own", cut_module)).otherwise(no)))
    keyed = _keys(each, "__all").withColumns({"__n": F.size("__own"), "__m": F.size("__b")})
    shift = "if(size(__all) > __n, __n, 0)"
    keyed = keyed.withColumns({"__ek": F.expr("slice(__k, 1, __m)"), "lk": F.expr("slice(__k, 1 + __m, __n - __m)"), "__ekc": F.expr(f"slice(__k, 1 + {shift}, __m)"), "lkc": F.expr(f"slice(__k, 1 + {shift} + __m, __n - __m)")})
    # The sorted events keep the bounds as they are written.
    keyed = keyed.withColumns({"ready": R.prepared("events", "__ek"), "ready_cut": R.prepared("events", "__ekc"), "keyless": F.exists("__k", lambda k: k.isNull())})
    # What needs more than a look at intervals: unreadable or missing bounds, and branches, which have no order.
    # A start from "0" and a limit are no versions, so they need no key.
    unread = F.expr("exists(concat(ready, ready_cut), e -> e.rank = 1 and e.key is null or e.rank = 0 and e.kind <> 'introduced' and e.zero is null)")
    odd = unread | F.expr("not exists(ready, e -> e.rank < 2)") | F.exists("__k", lambda k: F.coalesce(k, F.lit("")).startswith(V.BRANCH))
    # What can't be read at all is an error for every version; a bound of Maven's can be, with or without a key.
    bad = F.expr("get(transform(filter(ready, e -> e.rank = 1 and e.key is null), e -> e.bound), 0)")
    empty = F.when(F.expr("not exists(ready, e -> e.rank < 2)"), R.NO_EVENTS)
    dead = F.when((F.col("range_ord") != LISTED) & (F.coalesce("range_type", F.lit("")) != "GIT"), F.coalesce(empty, F.when((F.col("comparer") != "maven") & bad.isNotNull(), F.format_string(R.BAD_BOUND, bad))))
    keyed = keyed.withColumns({"spans": R.intervals("ready"), "spans_cut": R.intervals("ready_cut"), "odd": (F.col("range_ord") != LISTED) & F.coalesce(odd, F.lit(True)), "dead": dead})
    return keyed.select("ecosystem", "norm_name", "comparer", "database", "advisory_id", "aff_ord", "entry_stream", "tagged", "range_ord", "range_type", "fix_state", "events", "versions", "ready", "ready_cut", "spans", "spans_cut", "odd", "dead", "lk", "lkc", "keyless")


def candidates(inventory: DataFrame, affected: DataFrame) -> DataFrame:
    """Packages with the ranges and lists of the entries that bear their names, keys included. Keys are worked out once
    per package and once per entry, on either side of the join."""
    return _keyed_names(inventory).join(_keyed_ranges(affected), _NAME)


_NAME = ["ecosystem", "norm_name"]
_FOUND = ["package_id", "database", "advisory_id", "name_ord", "aff_ord", "range_ord", "fix_state", "outcome"]
_EVIDENCE = ("introduced", "fixed", "last_affected")


def _nulls(*names: str) -> list[Column]:
    return [F.lit(None).cast("string").alias(n) for n in names]


def _error(cause: str, reason: Column) -> Column:
    return F.struct(F.lit("error").alias("kind"), F.lit(cause).alias("cause"), *_nulls(*_EVIDENCE), reason.alias("reason"))


def _listed_hit(compared: str) -> Column:
    return F.struct(F.lit("hit").alias("kind"), *_nulls("cause", *_EVIDENCE), F.format_string("%s is listed as affected", compared).alias("reason"))


def found(inventory: DataFrame, affected: DataFrame) -> DataFrame:
    """What outcomes() gives for all candidates(), without making them: a row per range that isn't a miss."""
    return found_keyed(write_table(_keyed_names(inventory), "match-names"), write_table(_keyed_ranges(affected), "match-ranges"))


def _no_stream(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit("")) == ""


def _sound() -> Column:
    """Names whose version has a key with an order, and no stream."""
    return F.coalesce(~F.col("vk").startswith(V.BRANCH), F.lit(False)) & _no_stream("module_stream")


def _ways() -> tuple[Column, Column, Column, Column]:
    """Of ranges: whether they are swept, are lists of keys, can't be read at all, never hit."""
    free, listed, git = _no_stream("entry_stream") & ~F.col("tagged"), F.col("range_ord") == LISTED, F.coalesce("range_type", F.lit("")) == "GIT"
    return free & ~listed & ~F.col("odd") & ~git, free & listed & ~F.coalesce("keyless", F.lit(True)), free & F.col("dead").isNotNull(), free & ~listed & git


def found_keyed(names: DataFrame, ranges: DataFrame) -> DataFrame:
    """found() for written tables of _keyed_names() and _keyed_ranges()."""
    sound = _sound()
    plain, special = names.filter(sound), names.filter(~sound)
    in_sweep, in_lists, dead, _ = _ways()

    # Ranges: swept.
    by = F.concat_ws("\0", *_NAME).alias("by")
    points = plain.select("package_id", "name_ord", "compared", by, F.col("vk").alias("key"))
    spans = ranges.filter(in_sweep).select("database", "advisory_id", "aff_ord", "range_ord", "fix_state", by, F.explode("spans").alias("x"))
    spans = spans.select("*", *(f"x.{c}" for c in ("low", "high", "closed", *_EVIDENCE))).drop("x")
    held = interval_join(points, spans, "by", written=True)
    hit = F.struct(F.lit("hit").alias("kind"), *_nulls("cause"), *_EVIDENCE, R.hit_reason("compared", "introduced", "fixed", "last_affected").alias("reason"))
    swept = held.withColumn("outcome", hit).select(_FOUND)
    # Lists: equal keys.
    lists = ranges.filter(in_lists).select(*_NAME, "database", "advisory_id", "aff_ord", "range_ord", "fix_state", F.explode(F.array_distinct("lk")).alias("vk"))
    equal = plain.join(lists, [*_NAME, "vk"]).withColumn("outcome", _listed_hit("compared")).select(_FOUND)
    # What can't be read: all packages of the name that no stream sets apart.
    broken = ranges.filter(dead).select(*_NAME, "database", "advisory_id", "aff_ord", "range_ord", "fix_state", "dead")
    unread = names.filter(_no_stream("module_stream")).join(broken, _NAME).withColumn("outcome", _error("advisory", F.col("dead"))).select(_FOUND)
    # The rest, pair by pair.
    left = ranges.filter(~(in_sweep | in_lists | dead))
    pairs = plain.join(left, _NAME).unionByName(special.join(ranges.filter(~dead), _NAME)).unionByName(special.filter(~_no_stream("module_stream")).join(ranges.filter(dead), _NAME))
    return swept.unionByName(equal).unionByName(unread).unionByName(outcomes(pairs).select(_FOUND))


#: Above "", which stands for a version without a key, and below all keys.
_LEAST = "\x01"
_INTERVAL = "struct<low:string,high:string,closed:boolean,cause:string,introduced:string,fixed:string,last_affected:string,before:string,after:string>"


def _intervals(keyless: bool) -> Column:
    """All that a range of _ways() says, as intervals of keys: hits without a cause, errors with one, and their reason in
    words before and after the version (null after: without it). keyless: also what it says of versions without a key,
    which is an error where a bound or a listed version would have to be compared with them."""
    in_sweep, in_lists, dead, _ = _ways()
    text = lambda c: F.lit(c).cast("string")
    none = text(None)

    def one(low: Column, high: Column, closed: Column | bool, cause: Column, introduced: Column, fixed: Column, last: Column, before: Column, after: Column) -> Column:
        return F.struct(low, high, closed if isinstance(closed, Column) else F.lit(closed), cause, introduced, fixed, last, before, after).cast(_INTERVAL)

    words = lambda low, fix, last: R.hit_reason(text(""), low, fix, last)
    spans = F.transform("spans", lambda x: one(F.coalesce(x["low"], text(_LEAST)), x["high"], x["closed"], none, x["introduced"], x["fixed"], x["last_affected"], text(""), words(x["introduced"], x["fixed"], x["last_affected"])))
    keys = F.transform(F.array_distinct("lk"), lambda k: one(k, k, True, none, none, none, none, text(""), F.format_string("%s is listed as affected", text(""))))
    whole = F.array(one(none, none, False, text("advisory"), none, none, none, F.col("dead"), none))
    unread = one(text(""), text(""), True, text("target"), none, none, none, text("the version "), text(" could not be read"))
    start = one(text(""), text(""), True, none, text("0"), none, none, text(""), words(text("0"), none, none))
    compared = F.expr("exists(ready, e -> e.kind <> 'limit' and not (e.kind = 'introduced' and e.rank = 0))")
    if keyless:
        spans, keys = F.concat(spans, F.array(F.when(compared, unread).otherwise(start))), F.concat(keys, F.array(unread))
    return F.when(dead, whole).when(in_lists, keys).when(in_sweep, spans)


def first_found(inventory: DataFrame, affected: DataFrame) -> DataFrame:
    """What first_outcomes() gives for found()."""
    parts = int(inventory.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranges = _keyed_ranges(affected.repartition(parts))  # a small file is one partition, and its keys take long
    return first_found_keyed(write_table(_keyed_names(inventory), "match-names"), write_table(ranges, "match-ranges"))


def first_found_keyed(names: DataFrame, ranges: DataFrame) -> DataFrame:
    """first_found() for written tables of _keyed_names() and _keyed_ranges().

    A package meets an advisory under one name nearly always, and then all that decides about the two lies in one key
    range of the sweep: no pair is shuffled. Pairs under several names, packages that repeat and all that is compared
    pair by pair go the way of found() and first_outcomes()."""
    advisory, by = ["database", "advisory_id"], F.concat(F.col("ecosystem"), F.lit("\0"), F.col("norm_name"))
    again = write_table(names.filter("name_ord = 0").groupBy(F.xxhash64("package_id").alias("__id")).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("__id"), "match-again")
    if again.limit(1).count():
        names = names.withColumn("__id", F.xxhash64("package_id")).join(small(again.withColumn("__again", F.lit(True))), "__id", "left").drop("__id")
    else:
        names = names.withColumn("__again", F.lit(None).cast("boolean"))
    keyless = F.col("vk").isNull() & _no_stream("module_stream") & (V.comparer_of("ecosystem") != "maven")
    plain = F.coalesce((_sound() | keyless) & (F.col("lookups") > 0) & F.col("__again").isNull(), F.lit(False))
    names = names.withColumn("__way", F.when(~plain, 0).otherwise(F.col("lookups"))).drop("__again")
    n = names.agg(F.count_if(F.col("__way") == 0).alias("hard"), F.count_if(F.col("__way") == 2).alias("two"), F.count_if((F.col("__way") > 0) & F.col("vk").isNull()).alias("keyless")).first()

    easy = functools.reduce(lambda x, y: x | y, _ways()) & functools.reduce(lambda x, y: x & y, (F.col(c).isNotNull() for c in advisory))
    per = ranges.groupBy(*advisory, *_NAME).agg(F.bool_and(F.coalesce(easy, F.lit(False))).alias("__easy")).withColumn("__names", F.count(F.lit(1)).over(Window.partitionBy(*advisory)))
    other = write_table(per.filter("not __easy or __names > 1"), "match-other")
    m = other.agg(F.count_if(~F.col("__easy")).alias("hard"), F.count_if("__easy").alias("several")).first()
    if m.hard + m.several:
        on = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in (*advisory, *_NAME)]
        ranges = ranges.alias("a").join(small(other).alias("b"), on, "left").select("a.*", F.coalesce("b.__easy", F.lit(True)).alias("__easy"), (F.coalesce("b.__names", F.lit(1)) > 1).alias("__several"))
    else:
        ranges = ranges.withColumns({"__easy": F.lit(True), "__several": F.lit(False)})

    # Packages of two names lie apart: with an advisory of several names they may meet it twice.
    points = names.filter("__way > 0").select("package_id", "name_ord", "compared", F.concat(by, F.when(F.col("__way") == 2, "\0").otherwise("")).alias("by"), F.coalesce("vk", F.lit("")).alias("key"))
    ends = F.array(F.lit(""), F.when(~F.col("__several"), "\0")) if n.two else F.array(F.lit(""))
    spans = ranges.filter("__easy").select(*advisory, "aff_ord", "range_ord", "fix_state", by.alias("__by"), ends.alias("__ends"), F.explode(_intervals(n.keyless > 0)).alias("x"))
    spans = spans.withColumn("by", F.explode(F.array_compact("__ends"))).withColumn("by", F.concat("__by", "by")).join(small(points.select("by").distinct()), "by", "left_semi")
    spans = spans.select("by", "x.low", "x.high", "x.closed", F.concat_ws("\0", *advisory).alias("group"), F.col("aff_ord").alias("entry"), F.col("range_ord").alias("place"), F.col("x.cause").isNotNull().alias("error"), *advisory, "fix_state", *(f"x.{c}" for c in ("cause", *_EVIDENCE, "before", "after")))
    runs = first_intervals(points, spans, "by", ["package_id", "name_ord", "compared"])
    each = runs.select("hit", "skip", F.explode("points").alias("p"))

    def outcome(c: str, kind: str) -> Column:
        of = lambda x: F.col(f"{c}.{x}")
        reason = F.when(of("after").isNull(), of("before")).otherwise(F.concat(of("before"), F.col("p.compared"), of("after")))
        said = F.struct(F.lit(kind).alias("kind"), of("cause").alias("cause"), *(of(x).alias(x) for x in _EVIDENCE), reason.alias("reason"))
        return F.when(F.col(c).isNotNull(), F.struct(F.col("p.name_ord").alias("name_ord"), of("entry").alias("aff_ord"), of("place").alias("range_ord"), of("fix_state").alias("fix_state"), said.alias("outcome"))).alias(c)

    out = each.select("p.package_id", *(F.coalesce(f"hit.{c}", f"skip.{c}").alias(c) for c in advisory), outcome("hit", "hit"), outcome("skip", "error"))
    # The rest.
    way = lambda i: names.filter(f"__way = {i}").drop("__way")
    flags = ("__easy", "__several")
    ways = [(n.hard, 0, "true"), (m.hard, 1, "not __easy"), (n.two and m.hard + m.several, 2, "not __easy or __several")]
    rest = [found_keyed(way(i), ranges.filter(which).drop(*flags)) for some, i, which in ways if some]
    return out.unionByName(first_outcomes(functools.reduce(DataFrame.unionByName, rest))) if rest else out


def outcomes(pairs: DataFrame) -> DataFrame:
    """Of candidates() a row per range that isn't a miss: package_id, database, advisory_id, name_ord, aff_ord,
    range_ord, fix_state, outcome."""
    rows = pairs.withColumn("module", module_state(F.col("module_stream"), F.col("entry_stream"), F.col("comparer"), F.col("tagged"))).filter("module <> 'skip'")
    cut = F.col("module") == "cut"
    either = lambda whole, short: F.when(cut, F.col(short)).otherwise(F.col(whole))
    rows = rows.withColumns({"__vk": either("vk", "ck"), "__ready": either("ready", "ready_cut"), "__lk": either("lk", "lkc"), "__spans": either("spans", "spans_cut"), "compared_as": F.when(cut, cut_module(F.col("compared"))).otherwise(F.col("compared"))})
    # Most pairs are misses that a look at intervals or keys can tell; the rest is evaluated in full.
    hit = F.expr("exists(__spans, i -> (i.low is null or __vk >= i.low) and (i.high is null or __vk < i.high or (i.closed and __vk = i.high)))")
    listed = F.col("keyless") | F.expr("exists(__lk, k -> k = __vk)")
    open_ended = F.col("odd") | F.col("__vk").isNull() | F.col("__vk").startswith(V.BRANCH) | (F.col("module") == "error")
    rows = rows.filter(F.coalesce(open_ended | F.when(F.col("range_ord") == LISTED, listed).otherwise(hit), F.lit(True)))
    # Written once, as four ways read it: by now little more than hits and errors.
    rows = write_table(rows.drop("vk", "ck", "ready", "ready_cut", "spans", "spans_cut", "__spans", "lk", "lkc", "odd"), "match-rows")
    # Maven's plain versions have keys; what has any other is compared pairwise.
    pairwise = (F.col("comparer") == "maven") & (F.col("keyless") | F.col("__vk").isNull())
    maven, keyed = rows.filter(pairwise), rows.filter(~pairwise)
    unread = _error("target", F.format_string("the version %s could not be read", "compared"))
    # Of the listed versions those that can't be read are left out and counted, unless one that can is the hit.
    unreadable = F.expr("size(filter(__lk, k -> k is null))")
    some_unread = _error("advisory", F.format_string("%d of %d listed versions could not be read", unreadable, F.size("__lk")))
    listed_hit = _listed_hit("compared")
    miss = F.struct(F.lit("miss").alias("kind"), *_nulls("cause", *_EVIDENCE, "reason"))
    in_list = F.when(F.col("__vk").isNull(), unread).when(F.expr("exists(__lk, k -> k = __vk)"), listed_hit).when(unreadable > 0, some_unread).otherwise(miss)
    keep = [*_FOUND, "module"]
    a = R.evaluate(keyed.filter(f"range_ord <> {LISTED}"), "compared_as", range_type="range_type", key="__vk", ready="__ready")
    b = keyed.filter(f"range_ord = {LISTED}").withColumn("outcome", in_list)
    m = maven.filter(f"range_ord <> {LISTED} and range_type <> 'GIT'").withColumn("outcome", R.evaluate_maven("compared_as", "events"))
    out = a.select(keep).unionByName(b.select(keep)).unionByName(m.select(keep)).unionByName(_maven_lists(maven).select(keep))
    tagged = _error("advisory", F.lit("a module build's bound, and the package has no stream"))
    return out.withColumn("outcome", F.when(F.col("module") == "error", tagged).otherwise(F.col("outcome"))).drop("module").filter("outcome.kind <> 'miss'")


def _maven_lists(rows: DataFrame) -> DataFrame:
    """Listed versions of Maven entries, compared pairwise."""
    one = rows.filter(f"range_ord = {LISTED}").withColumn("__one", F.explode("versions"))
    same = one.filter(V.maven_compare_udf("compared_as", "__one") == 0)
    hit = _listed_hit("compared")
    return same.drop("__one").dropDuplicates(["package_id", "database", "advisory_id", "name_ord", "aff_ord"]).withColumn("outcome", hit)


def first_outcomes(found: DataFrame) -> DataFrame:
    """A row per (package, advisory): hit (its first one by name, entry and range) and skip (the first error before it).
    The first outcome of an entry decides it. One shuffle and one sort: the aggregates use the window's order."""
    key, entry = ["package_id", "database", "advisory_id"], ["name_ord", "aff_ord"]
    order = Window.partitionBy(*key).orderBy(*entry, "range_ord")
    before = F.lag(F.struct(*entry)).over(order)
    decided = found.withColumn("__before", before).filter(~F.col("__before").eqNullSafe(F.struct(*entry)))
    row = F.struct(*entry, "range_ord", "fix_state", "outcome")
    first = decided.groupBy(*key).agg(F.min(F.when(F.col("outcome.kind") == "hit", row)).alias("hit"), F.min(F.when(F.col("outcome.kind") == "error", row)).alias("skip"))
    at = lambda c: F.struct(*(F.col(f"{c}.{x}") for x in entry))
    return first.withColumn("skip", F.when(F.col("hit").isNull() | (at("skip") < at("hit")), F.col("skip")))


def scan(inventory: DataFrame, affected: DataFrame, ecosystems: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(found, skipped): first_outcomes() of the packages that can be checked, and the packages that can't, with
    skip_reason. Packages that repeat cost their repeats: give distinct ones."""
    guarded = write_table(guard(inventory, ecosystems), "match-guarded")  # read three times
    return first_found(guarded.filter("skip_reason is null").drop("skip_reason"), affected), guarded.filter("skip_reason is not null")


def affected_versions(installed: DataFrame, advisories: DataFrame, comparer: str) -> DataFrame:
    """The hits alone, for one ordering and many packages: installed (name, version, any others) with each advisory
    (advisory_id, name, events) that holds the version, and fixed and last_affected, its evidence.

    Keys are worked out once per version, intervals once per advisory, and they meet in a sweep. Versions and bounds of
    Maven that have no key are compared pairwise, apart."""
    key = F.get(V.python_keys(F.lit(comparer), F.array("version")), F.lit(0)) if comparer in V.PYTHON else V.key(comparer, "version")
    table = key_table(installed.select(F.lit(comparer).alias("comparer"), "version"), F.array("version"))
    inv = installed.withColumn("__key", key) if table is None else installed.join(table.select(F.col("v").alias("version"), F.col("k").alias("__key")), "version", "left")
    inv = write_table(inv, "match-installed")
    adv = advisories.withColumn("bounds", R.bounds("events"))
    adv = adv.withColumn("keys", V.python_keys(F.lit(comparer), F.col("bounds")) if comparer in V.PYTHON else R.native_keys(comparer, "bounds")).drop("bounds")
    plain = F.forall("keys", lambda k: k.isNotNull())
    keyed = adv.filter(plain) if comparer == "maven" else adv
    spans = keyed.select("advisory_id", "name", R.prepared("events", "keys").alias("ready")).select("advisory_id", "name", F.explode(R.intervals("ready")).alias("x"))
    spans = spans.select("advisory_id", "name", "x.low", "x.high", "x.closed", "x.fixed", "x.last_affected")
    cols = [*installed.columns, "advisory_id", "fixed", "last_affected"]
    hits = interval_join(inv.filter("__key is not null"), spans, "name", "__key", written=True).select(cols)
    if comparer != "maven":
        # A version without a key is inside only where no bound has to be compared with it.
        return hits.unionByName(inv.filter("__key is null").join(spans.filter("low is null and high is null"), "name").select(cols))
    odd, others = inv.filter("__key is null"), adv.filter(~plain)
    pairs = odd.join(adv, "name").unionByName(inv.filter("__key is not null").join(others, "name"))
    walked = pairs.select(*installed.columns, "advisory_id", R.evaluate_maven("version", "events").alias("o")).filter("o.kind = 'hit'")
    return hits.unionByName(walked.select(*installed.columns, "advisory_id", "o.fixed", "o.last_affected"))


def listed_versions(installed: DataFrame, listed: DataFrame, comparer: str) -> DataFrame:
    """installed (name, version) whose version equals, in a native ordering, one of listed (advisory_id, name, listed):
    an equi-join on keys."""
    left, right = installed.withColumn("key", V.key(comparer, "version")), listed.withColumn("key", V.key(comparer, "listed"))
    return left.join(right, ["name", "key"]).select(*installed.columns, "advisory_id").distinct()


def group_advisories(hits: DataFrame) -> DataFrame:
    """hits (package_id, database, advisory_id, aliases, score) with group_no, the record that names the group within
    its package, identifiers (all that its records bear), and winner, whether it is the one displayed: rated before
    unrated, the highest score, then database and id in ascending order.

    Records that share an identifier, directly or through others, are one group: components over links between a
    record and the identifiers that it shares with another, so no package's records are gathered. Most packages have no
    shared identifier at all and take no part in the rounds."""
    none = F.array().cast("array<string>")
    rows = hits.withColumn("record", F.concat_ws("\0", "database", "advisory_id")).withColumn("ids", F.array_distinct(F.concat(F.array("advisory_id"), F.coalesce("aliases", none))))
    bears = rows.select("package_id", "record", F.explode("ids").alias("id")).filter("id <> ''")
    shared = bears.groupBy("package_id", "id").agg(F.min("record").alias("least"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    node = lambda r: F.struct(F.col("package_id").alias("p"), F.col(r).alias("r"))
    edges = bears.join(shared, ["package_id", "id"]).filter("record <> least").select(node("record").alias("a"), node("least").alias("b"))
    roots = components(edges).select(F.col("node.p").alias("package_id"), F.col("node.r").alias("record"), F.col("root.r").alias("root"))
    flat = rows.join(roots, ["package_id", "record"], "left").withColumn("group_no", F.coalesce("root", "record")).drop("root")
    rank = F.struct(F.col("score").isNull(), -F.coalesce("score", F.lit(0.0)), "database", "advisory_id")
    best = flat.groupBy("package_id", "group_no").agg(F.min(rank).alias("best"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("ids")))).alias("identifiers"))  # the ids of one vulnerability
    return flat.join(best, ["package_id", "group_no"]).withColumn("winner", rank == F.col("best")).drop("best", "record", "ids")


def fix_state(ratings: str) -> Column:
    """Of an array of ratings with fixed and fix_state: fixed if any is, else wont-fix, else not-fixed, else unknown."""
    state = F.expr(f"transform({ratings}, r -> case when r.fixed <> '' then 'fixed' else coalesce(nullif(r.fix_state, ''), 'unknown') end)")
    has = lambda s: F.array_contains(state, s)
    return F.when(has("fixed"), "fixed").when(has("wont-fix"), "wont-fix").when(has("not-fixed"), "not-fixed").otherwise("unknown")
