"""Operators that depend on the order of rows, without a single task that holds them all."""

from __future__ import annotations

import functools
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cloister.functions.expr import BLOCK, HALO, PLACE, Pass, Side, Whole, ranks_of
from cloister.functions import scans
from cloister.sources.scratch import materialise


def row_index(df: DataFrame, order: Sequence[Column], name: str = "index") -> DataFrame:
    """Dense 0-based index as the first column, in ``order``; rows equal in it are told apart by a hash of all columns.

    Rows are range-partitioned and sorted, and that table is written once; an index is then the
    place within the partition and the number of rows in the partitions before it.
    """
    spark = df.sparkSession
    tie = F.xxhash64(*[F.col(f"`{c}`") for c in df.columns])
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = df.repartitionByRange(parts, *order, tie).sortWithinPartitions(*order, tie).withColumn("__place", F.monotonically_increasing_id())
    placed = materialise(placed, "row-index")
    bits = 33  # of a place, those within a partition
    part, within = F.shiftright("__place", bits), F.col("__place").bitwiseAND((1 << bits) - 1)
    sizes = placed.groupBy(part.alias("__part")).agg(F.count(F.lit(1)).alias("n")).orderBy("__part").collect()  # one row for each partition
    starts, total = [], 0
    for row in sizes:
        starts.append((row["__part"], total))
        total += row["n"]
    if not starts:
        return placed.select(F.lit(0).cast("long").alias(name), *df.columns)
    offsets = F.broadcast(spark.createDataFrame(starts, "__part long, __start long"))
    return placed.join(offsets, part == F.col("__part")).select((F.col("__start") + within).alias(name), *[F.col(f"`{c}`") for c in df.columns])


def shift_rows(df: DataFrame, order: Sequence[Column], n: int = 1, fill=None) -> DataFrame:
    """All columns moved ``n`` rows down (up if negative), by a join on the row index; ``fill`` for rows moved in from outside.

    The result keeps the original row's place as the hidden order column ``__ord``.
    """
    indexed = row_index(df, order, "__ord")
    moved = indexed.select((F.col("__ord") + n).alias("__ord"), F.lit(True).alias("__in"), *[F.col(f"`{c}`").alias(f"__m_{c}") for c in df.columns])
    joined = indexed.select("__ord").join(moved, "__ord", "left")
    out = []
    for field in df.schema:
        value = F.col(f"`__m_{field.name}`")
        if fill is not None:
            value = F.when(F.col("__in"), value).otherwise(F.lit(fill).try_cast(field.dataType))
        out.append(value.alias(field.name))
    return joined.select("__ord", *out)


def every_nth(df: DataFrame, order: Sequence[Column], n: int) -> DataFrame:
    return row_index(df, order, "__ord").where(F.col("__ord") % n == 0).drop("__ord")


#: Rows of a block in operators that look along the whole frame.
BLOCK_ROWS = 1_000_000


def in_blocks(df: DataFrame, whole: Whole, prepared: Sequence[tuple[str, Column]] = (), by: Sequence[str] = ()) -> DataFrame:
    """The rows of an indexed frame in blocks, with the copies, carried values and ranks that ``whole`` asks for.

    A fold over blocks takes one row of a block to the driver; ranks are joins with a table of distinct values.  With ``by`` the
    index goes by group first, and values are carried within groups only.
    """
    for name, value, reverse in whole.ranks:
        df = _ranked(df, name, value, reverse)
    for name, keys in whole.places:
        placed = row_index(df, [*keys, F.col(PLACE)], name)
        df = df.join(placed.select(name, PLACE), PLACE)
    block = lambda shift: F.floor((F.col(PLACE) + shift) / BLOCK_ROWS)
    own = block(0)
    if whole.before or whole.after:
        df = df.withColumn(BLOCK, F.explode(F.sequence(F.greatest(block(-whole.after), F.lit(0)), block(whole.before))))
    else:
        df = df.withColumn(BLOCK, own)
    df = df.withColumn(HALO, F.col(BLOCK) != own)
    for name, column in prepared:
        df = df.withColumn(name, column)
    if whole.scans:
        df = _scanned(df, whole, by, in_order=not (prepared or whole.ranks or whole.places))
    return df if not whole.carries else _carried(df, whole, by)


def _scanned(df: DataFrame, whole: Whole, by: Sequence[str], in_order: bool) -> DataFrame:
    """Functions in Python of each segment's values in order, joined to the rows by their place.  Only places and values go to Python.

    What folds carry from block to block is found first: a state for each piece of a block, rows that follow each other in one task, passes the
    driver.  Rows that are not ``in_order`` in their tasks, as a sort by place leaves them, are shuffled for that."""
    names, runs = [name for name, *_ in whole.scans], [run for *_, run in whole.scans]
    hashes, segment = dict(zip(["__h0", "__h1"], _hashes(by), strict=True)), [BLOCK, "__h0", "__h1"]
    narrow = df.withColumns(hashes).select(*segment, PLACE, HALO, *[value.alias(f"__v{i}") for i, (_, value, _) in enumerate(whole.scans)])
    carrying = [(i, run) for i, run in enumerate(runs) if run.carries]
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    if carrying:
        narrow = materialise(narrow if in_order else narrow.repartition(parts, BLOCK).sortWithinPartitions(BLOCK, PLACE), "scan-values")
        states = [f"__s{i}" for i, _ in carrying]
        schema = f"{BLOCK} long, __from long, __f0 long, __f1 long, __h0 long, __h1 long, {', '.join(f'{s} binary' for s in states)}"
        found = narrow.where(~F.col(HALO)).mapInArrow(lambda batches: scans.pieces(batches, carrying), schema).collect()  # a row or a few for each block
        table, block, group, state = [], None, None, None
        for row in sorted(found, key=lambda r: r["__from"]):
            first, last = (row["__f0"], row["__f1"]), (row["__h0"], row["__h1"])
            if first == group and row[BLOCK] != block:
                table.append((row[BLOCK], *first, *state))
            before = state if first == group and first == last else [None] * len(carrying)
            state = [run.merged(old, row[s]) for (_, run), old, s in zip(carrying, before, states, strict=True)]
            block, group = row[BLOCK], last
        carried = df.sparkSession.createDataFrame(table, f"{BLOCK} long, __h0 long, __h1 long, {', '.join(f'{s} binary' for s in states)}")
        narrow = narrow.join(F.broadcast(carried), segment, "left")
    schema = ", ".join([f"{PLACE} long", *[f"{name} {run.dtype}" for name, run in zip(names, runs, strict=True)]])
    asked = list(zip(names, runs, strict=True))
    # A number of partitions that is given keeps small values from being put together in few tasks.
    out = narrow.repartition(parts, *segment).groupBy(*segment).applyInArrow(lambda rows: scans.in_turn(rows, asked), schema)
    return df.join(out, PLACE, "left")


def _hashes(by: Sequence[str]) -> list[Column]:
    """Two hashes that tell groups apart; null differs from other values."""
    parts = [c for k in by for c in (F.col(k).isNull(), F.col(k))]
    return [F.xxhash64(F.lit(seed), *parts) for seed in (1, 2)]


def _carried(df: DataFrame, whole: Whole, by: Sequence[str]) -> DataFrame:
    """The carries of ``whole`` joined to the rows.  As groups are in order, only a block's first group can go on from the block
    before it, and only its last one in the block after it, so the driver folds one row of a block."""
    names, kinds = [name for name, *_ in whole.carries], ["__h0", "__h1"]
    df = df.withColumns(dict(zip(kinds, _hashes(by), strict=True)))
    groups = df.where(~F.col(HALO)).groupBy(BLOCK, *kinds).agg(F.min(PLACE).alias("__from"), *[c.alias(n) for n, c, _, _ in whole.carries])
    edge = F.struct(*kinds, *names)
    found = groups.groupBy(BLOCK).agg(F.min_by(edge, "__from").alias("first"), F.max_by(edge, "__from").alias("last")).orderBy(BLOCK).collect()  # one row for each block
    out: dict[tuple, dict] = {}
    for name, _, fold, backward in whole.carries:
        state, group = None, None
        for row in reversed(found) if backward else found:
            enters, leaves = (row["last"], row["first"]) if backward else (row["first"], row["last"])
            key = (enters["__h0"], enters["__h1"])
            carried = state if key == group else None
            out.setdefault((row[BLOCK], *key), {})[name] = carried
            group = (leaves["__h0"], leaves["__h1"])
            state = fold(carried if group == key else None, leaves[name])
    types = {f.name: f.dataType for f in groups.schema}
    schema = T.StructType([T.StructField(n, types[n]) for n in (BLOCK, *kinds, *names)])
    table = df.sparkSession.createDataFrame([(*key, *[values.get(n) for n in names]) for key, values in out.items()], schema)
    return df.join(F.broadcast(table), [BLOCK, *kinds], "left")


def largest_group(df: DataFrame, keys: Sequence[Column]) -> int:
    """Rows of the largest group, from counts that are summed up before they are shuffled."""
    counts = df.groupBy(*[k.alias(f"__k{i}") for i, k in enumerate(keys)]).agg(F.count(F.lit(1)).alias("n"))
    return counts.agg(F.max("n")).first()[0] or 0


def in_segments(df: DataFrame, own: Pass, order: Sequence[Column]) -> DataFrame:
    """The frame with the outputs of a pass: windows over groups, of which no task holds more than a block.

    Aggregates of groups are joined to their rows from a table with a row for each group, which is written, so that its size decides how."""
    kept, names = df.columns, own.names
    df = df.withColumns(dict(zip(names, own.keys, strict=True)))
    if own.aggregates:
        table = materialise(df.groupBy(*names).agg(*[c.alias(n) for n, c in own.aggregates]), "groups")
        table = table.withColumnsRenamed({n: f"__of{n}" for n in names})
        df = df.join(table, functools.reduce(lambda a, b: a & b, [F.col(n).eqNullSafe(F.col(f"__of{n}")) for n in names]), "left")
    if own.whole.used:
        df = in_blocks(row_index(df, [*map(F.col, names), *order], PLACE), own.whole, own.prepared, names)
    else:
        df = df.withColumn(HALO, F.lit(False))
        for name, column in own.prepared:
            df = df.withColumn(name, column)
    outputs = [c.alias(n) for n, c in own.outputs]
    return df.select(*[F.col(f"`{c}`") for c in kept], HALO, *outputs).where(~F.col(HALO)).drop(HALO)


def _ranked(df: DataFrame, name: str, value: Column, reverse: bool) -> DataFrame:
    counts = df.select(value.alias("__v")).where("__v is not null").groupBy("__v").agg(F.count(F.lit(1)).alias("__n"))
    placed = row_index(counts, [F.desc("__v") if reverse else F.asc("__v")], "__dense").withColumn("__b", F.floor(F.col("__dense") / BLOCK_ROWS))
    sums = sorted(placed.groupBy("__b").agg(F.sum("__n").alias("n")).collect(), key=lambda r: r["__b"])  # one row for each block of values
    starts, total = [], 0
    for r in sums:
        starts.append((r["__b"], total))
        total += r["n"]
    so_far = Window.partitionBy("__b").orderBy("__dense").rowsBetween(Window.unboundedPreceding, -1)
    placed = placed.join(F.broadcast(df.sparkSession.createDataFrame(starts, "__b long, __s long")), "__b")
    start = F.col("__s") + F.coalesce(F.sum("__n").over(so_far), F.lit(0))
    table = placed.select(F.col("__v").alias(f"{name}_v"), start.alias(f"{name}_start"), F.col("__n").alias(f"{name}_n"), F.col("__dense").alias(f"{name}_dense"))
    return df.join(table, value == F.col(f"{name}_v"), "left")


def interpolate_rows(df: DataFrame, order: Sequence[Column], columns: Sequence[str]) -> DataFrame:
    """Linear fill of nulls between known values, by position, in blocks of rows."""
    from cloister.functions.expr import Compile, col

    context = Compile("row", tuple(order), whole=Whole())
    filled = {c: col(c).interpolate().build(context) for c in columns}
    context.whole.used = True
    rows = in_blocks(row_index(df, order, PLACE), context.whole, context.prepared)
    return rows.select(*[filled[c].alias(c) if c in filled else F.col(f"`{c}`") for c in df.columns])


def in_time_blocks(df: DataFrame, by: Sequence[str], key: Column, low: int, high: int) -> DataFrame:
    """Each row in a block, and copied (``__halo``) to the other blocks of its ``by`` group whose rows have it in their window, from ``low``
    to ``high`` around their ``key`` (microseconds).

    If a group is large, rows are sorted by group and key and cut into blocks.  A group's blocks follow each other,
    so the driver tells from the ends of blocks, one row of each, which are within a window's reach.  Else a group is a block.
    """
    if largest_group(df, [F.col(f"`{c}`") for c in by]) <= BLOCK_ROWS:
        return df.withColumn(BLOCK, F.lit(0).cast("long")).withColumn(HALO, F.lit(False))
    names = [f"__g{i}" for i in range(len(by))]
    placed = df.withColumns({n: F.col(f"`{c}`") for n, c in zip(names, by, strict=True)}).withColumn("__t", key)
    placed = row_index(placed, [*map(F.col, names), F.col("__t")], PLACE).withColumn(HALO, F.lit(False))
    placed = placed.withColumns(dict(zip(["__h0", "__h1"], _hashes(names), strict=True)))
    # Rows without a time are each other's window: they stay together.
    placed = placed.withColumn(BLOCK, F.when(F.col("__t").isNotNull(), F.floor(F.col(PLACE) / BLOCK_ROWS)).otherwise(-1))
    groups = placed.where(F.col(BLOCK) >= 0).groupBy(BLOCK, "__h0", "__h1").agg(F.min(PLACE).alias("__from"), F.min("__t").alias("low"), F.max("__t").alias("high"))
    edge = F.struct("__h0", "__h1", "low", "high")
    ends = groups.groupBy(BLOCK).agg(F.min_by(edge, "__from").alias("first"), F.max_by(edge, "__from").alias("last")).orderBy(BLOCK).collect()  # one row for each block
    group = lambda e: (e["__h0"], e["__h1"])
    copies = []
    for at, end in enumerate(ends):
        for step, mine, theirs in ((-1, "first", "last"), (1, "last", "first")):
            own, other = end[mine], at + step
            while 0 <= other < len(ends) and group(ends[other][theirs]) == group(own):
                far = ends[other][theirs]
                before, after = far["high"] < own["low"] + low, far["low"] > own["high"] + high
                if before if step < 0 else after:
                    break  # blocks farther off are out of reach, too
                if not (before or after):
                    copies.append((ends[other][BLOCK], end[BLOCK], *group(own), own["low"] + low, own["high"] + high))
                if group(ends[other]["first"]) != group(ends[other]["last"]):
                    break
                other += step
    table = df.sparkSession.createDataFrame(copies, f"{BLOCK} long, __to long, __h0 long, __h1 long, __low long, __high long")
    reached = F.col("__t").between(F.col("__low"), F.col("__high"))
    halo = placed.join(F.broadcast(table), [BLOCK, "__h0", "__h1"]).where(reached).withColumns({BLOCK: F.col("__to"), HALO: F.lit(True)})
    columns = [*[F.col(f"`{c}`") for c in df.columns], F.col(BLOCK), F.col(HALO)]
    return placed.select(*columns).unionAll(halo.select(*columns))


def unique(df: DataFrame, subset: Sequence[str] | None, keep: str, order: Sequence[Column]) -> DataFrame:
    """Distinct rows, or the first or last row of each value of ``subset`` in ``order``."""
    if subset is None or set(subset) == set(df.columns):
        return df.distinct()
    if not order:
        return df.dropDuplicates(list(subset))
    if keep not in ("first", "last"):
        raise ValueError("keep must be first or last")
    pick = F.min_by if keep == "first" else F.max_by
    row, key = F.struct(*[F.col(f"`{c}`") for c in df.columns]), F.struct(*order)
    return df.groupBy(*subset).agg(pick(row, key).alias("__row")).select("__row.*")


def with_sides(df: DataFrame, keys: Sequence[Column], sides: Sequence[Side]) -> DataFrame:
    """The rows with the values of their group in each side table; a table is written, so that its size decides how it is joined."""
    base, own = df, [f"__k{i}" for i in range(len(keys))]
    for number, side in enumerate(sides):
        table = materialise(side.make(base, keys, side.requests), "side")
        if not keys:
            df = df.crossJoin(F.broadcast(table))  # one row
            continue
        table = table.toDF(*[f"__s{number}{c}" if c in own else c for c in table.columns])
        same = functools.reduce(lambda a, b: a & b, [key.eqNullSafe(F.col(f"__s{number}{k}")) for key, k in zip(keys, own, strict=True)])
        df = df.join(table, same, "left")
    return df


#: A quantile's rank is looked for among values whose ranks are this share of a group apart, or among all of a group of so many times as few.
QUANTILE_SHARE, WHOLE_GROUP = 10_000, 40_000


def group_quantiles(df: DataFrame, keys: Sequence[Column], value: Column, asked: dict[str, tuple[float, str]]) -> DataFrame:
    """``__k0, ...`` and a column for each quantile (q, interpolation) in ``asked``, exact for each group.

    Approximate percentiles, which are summed up before the shuffle, give bounds that surely hold the ranks; the values
    between them are counted, also before the shuffle, and the ranks are found by adding up these counts: of a group of n
    rows about 4 n / ``QUANTILE_SHARE`` values are looked at in order for each quantile.
    """
    own = [f"__k{i}" for i in range(len(keys))]
    rows = df.select(*[k.alias(n) for k, n in zip(keys, own, strict=True)], value.alias("__v")).where("__v is not null")
    margin, places = 2 / QUANTILE_SHARE, sorted({q for q, _ in asked.values()})
    bounds = F.percentile_approx("__v", [p for q in places for p in (max(q - margin, 0.0), min(q + margin, 1.0))], QUANTILE_SHARE)
    stats = rows.groupBy(*own).agg(F.count(F.lit(1)).alias("__n"), F.min("__v").alias("__min"), F.max("__v").alias("__max"), bounds.alias("__b"))
    few = F.col("__n") < WHOLE_GROUP
    low = [F.when(few | F.lit(q <= margin), F.col("__min")).otherwise(F.col("__b")[2 * i]).alias(f"__low{i}") for i, q in enumerate(places)]
    high = [F.when(few | F.lit(q >= 1 - margin), F.col("__max")).otherwise(F.col("__b")[2 * i + 1]).alias(f"__high{i}") for i, q in enumerate(places)]
    stats = materialise(stats.select(*own, "__n", *low, *high), "quantile-bounds")
    if own:
        theirs = stats.toDF(*[f"__s{c}" if c in own else c for c in stats.columns])
        same = functools.reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__s{k}")) for k in own])
        near = rows.join(theirs, same)
    else:
        near = rows.crossJoin(F.broadcast(stats))  # one row
    # A value between two bounds counts as the next lower bound, which changes no sum of counts within bounds.
    v = F.col("__v")
    counted = functools.reduce(lambda rest, i: F.when(v < F.col(f"__low{i}"), F.col(f"__low{i}")).when(v <= F.col(f"__high{i}"), v).otherwise(rest), reversed(range(len(places))), F.lit(None))
    near = near.withColumn("__w", counted).where("__w is not null")
    counts = near.groupBy(*own, "__n", "__w").agg(F.count(F.lit(1)).alias("__c"))
    so_far = Window.partitionBy(*own, "__n").orderBy("__w").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    counts = counts.withColumn("__upto", F.sum("__c").over(so_far))
    out = []
    for name, (q, interpolation) in asked.items():
        found = [F.min(F.when(F.col("__upto") > rank(F.col("__n")), F.col("__w"))).cast("double") for rank in ranks_of(q, interpolation)]
        if interpolation == "linear":
            place = (F.max("__n") - 1) * F.lit(float(q))
            out.append((found[0] + (found[1] - found[0]) * (place - F.floor(place))).alias(name))
        else:
            out.append((functools.reduce(lambda a, b: a + b, found) / len(found)).alias(name))
    return counts.groupBy(*own).agg(*out)


def column_quantiles(df: DataFrame, columns: Sequence[str], q: float, interpolation: str) -> DataFrame:
    """One row with the quantile of each column (numbers), all found in the same passes, as of groups."""
    if not columns:
        return df.sparkSession.range(1).select()
    pairs = F.array(*[F.struct(F.lit(i).alias("i"), F.col(f"`{c}`").cast("double").alias("v")) for i, c in enumerate(columns)])
    rows = df.select(F.explode(pairs).alias("p")).select("p.i", "p.v")
    found = group_quantiles(rows, [F.col("i")], F.col("v"), {"__q": (q, interpolation)})
    return found.agg(*[F.max(F.when(F.col("__k0") == i, F.col("__q"))).alias(c) for i, c in enumerate(columns)])


def group_places(df: DataFrame, keys: Sequence[Column], value: Column, order: Sequence[Column], low: int, high: int, backward: bool, names: Sequence[str]) -> DataFrame:
    """``__k0, ...`` and, under each of ``names``, the values at places ``low`` to ``high`` (from 1) of each group as a list of ``{n, v}`` in order; only rows up to
    ``high`` leave a task."""
    own = [f"__k{i}" for i in range(len(keys))]
    by = [f"__o{i}" for i in range(len(order))]
    rows = df.select(*[k.alias(n) for k, n in zip(keys, own, strict=True)], *[o.alias(n) for o, n in zip(order, by, strict=True)], value.alias("__v"))
    w = Window.partitionBy(*own).orderBy(*[F.desc(n) if backward else F.asc(n) for n in by])
    rows = rows.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= high).where(F.col("__n") >= low)
    place = -F.col("__n") if backward else F.col("__n")
    found = F.array_sort(F.collect_list(F.struct(place.alias("n"), F.col("__v").alias("v"))))
    return rows.groupBy(*own).agg(*[found.alias(n) for n in names])


#: A group of rows with the same ``by`` values beyond this is cut into blocks for an as-of join.
ASOF_GROUP_ROWS = 1_000_000


def asof_join(
    left: DataFrame,
    right: DataFrame,
    left_on: str,
    right_on: str,
    by_left: Sequence[str] = (),
    by_right: Sequence[str] = (),
    strategy: str = "backward",
    tolerance=None,
    suffix: str = "_right",
) -> DataFrame:
    """Each left row with the nearest right row of the same ``by`` values: the last at or before its key ("backward")
    or the first at or after it ("forward"); nulls where there is none, or none within ``tolerance``.

    Both sides are put in one table, sorted by key within ``by``, and each left row takes the last
    right row seen.  If a group of ``by`` is large (without ``by``, all rows are one), the sorted table is cut into
    blocks of rows, so that no task holds a whole group however close its keys are: a left row that finds nothing in its
    block takes what the group's blocks before it end with.
    """
    if strategy not in ("backward", "forward"):
        raise ValueError("strategy must be backward or forward")
    forward = strategy == "forward"
    rename = {c: c + suffix if c in left.columns else c for c in right.columns}
    payload = [c for c in right.columns if c not in by_right and not (c == right_on and right_on == left_on)]
    keys = [f"__by{i}" for i in range(len(by_left))]
    l_row = F.struct(*[F.col(f"`{c}`") for c in left.columns])
    r_row = F.struct(F.col(f"`{right_on}`").alias("__k"), *[F.col(f"`{c}`").alias(f"__r_{c}") for c in payload])
    l_type, r_type = left.select(l_row.alias("l")).schema["l"].dataType, right.select(r_row.alias("r")).schema["r"].dataType

    def side(df: DataFrame, on: str, by: Sequence[str], number: int, l: Column, r: Column) -> DataFrame:  # noqa: E741
        return df.select(*[F.col(f"`{c}`").alias(k) for c, k in zip(by, keys, strict=True)], F.col(f"`{on}`").alias("__key"), F.lit(number).alias("__side"), l.alias("__l"), r.alias("__r"))

    both = side(left, left_on, by_left, 1, l_row, F.lit(None).cast(r_type)).unionByName(
        side(right.where(F.col(f"`{right_on}`").isNotNull()), right_on, by_right, 0, F.lit(None).cast(l_type), r_row)
    )
    order = [F.col("__key").desc() if forward else F.col("__key").asc(), F.col("__side").asc()]
    large = largest_group(both, [F.col(k) for k in keys]) > ASOF_GROUP_ROWS
    if large:
        both = row_index(both, [*map(F.col, keys), *order], PLACE).withColumn(BLOCK, F.floor(F.col(PLACE) / ASOF_GROUP_ROWS))
        order = [F.col(PLACE)]
    groups = [*keys, BLOCK] if large else keys
    w = Window.partitionBy(*groups).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = both.withColumn("__near", F.last("__r", ignorenulls=True).over(w)).where("__side = 1").drop("__r")
    if large:
        last = both.groupBy(*groups).agg(F.max_by("__r", F.when(F.col("__side") == 0, F.col(PLACE))).alias("__last"))
        before = Window.partitionBy(*keys).orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, -1)  # a row for each block of a group
        edges = last.withColumn("__edge", F.last("__last", ignorenulls=True).over(before)).drop("__last").where("__edge is not null")
        edges = materialise(edges, "asof-edges")  # a block has one group at most that goes on from another
        edges = edges.toDF(*[f"__e{c}" if c != "__edge" else c for c in edges.columns])
        same = functools.reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"__e{c}")) for c in groups])
        found = found.join(edges, same, "left").withColumn("__near", F.coalesce("__near", "__edge"))
    near = F.col("__near")
    within = F.col("__key").isNotNull()
    for k in keys:
        within = within & F.col(k).isNotNull()
    if tolerance is not None:
        gap = near["__k"] - F.col("__key") if forward else F.col("__key") - near["__k"]
        within = within & (gap <= (F.expr(tolerance) if isinstance(tolerance, str) else F.lit(tolerance)))
    near = F.when(within, near)
    return found.select("__l.*", *[near[f"__r_{c}"].alias(rename[c]) for c in payload])
