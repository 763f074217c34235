"""Key constraints on rows to be added: primary and unique keys (L-07, M-06) and any number of
foreign keys at once (L-10).

A *screen* is a bitmap of key hashes, built by one distributed aggregate. It has a fixed size
(``SCREEN_BITS`` bits, in rows of 4 KB), so it may be broadcast whatever the size of the keys
it stands for: a row whose bit is not set surely has none of them. Large sides (the target of
an append, the parents of a check) are screened in their scan; only what passes is shuffled
for the exact comparison.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewright.functions.tsql import quote_ident
from tablewright.session import materialize

SCREEN_BITS = 26           # 8 MB
_ROW_BITS = 15             # bits of one row of a screen: what bitmap_construct_agg holds


@dataclass(frozen=True)
class KeyConstraint:
    """A primary or unique key. A primary key takes no NULL; in a unique key NULLs count as
    equal, so it takes one of them."""
    name: str
    columns: tuple
    primary: bool = False


@dataclass(frozen=True)
class ForeignKey:
    """``columns`` of the child must be found in ``parent_columns`` of the parent. A row with
    a NULL among them is not checked."""
    name: str
    columns: tuple
    parent: DataFrame
    parent_columns: tuple


def key_constraints(catalog_rows, key_columns=None) -> list[KeyConstraint]:
    """The key constraints of one table from its collected catalogue rows (M-04): the columns
    flagged ``is_primary_key`` are one key, each column flagged ``is_unique_key`` one of its
    own. ``key_columns`` (collected rows with constraint_name, column_name, is_primary_key;
    column order as given) names composite unique keys instead."""
    if key_columns is not None:
        groups: dict = {}
        for r in key_columns:
            groups.setdefault((r["constraint_name"], bool(r["is_primary_key"])), []).append(r["column_name"])
        return [KeyConstraint(name, tuple(cols), primary) for (name, primary), cols in groups.items()]
    flag = lambda r, name: bool((r if isinstance(r, dict) else r.asDict()).get(name))
    rows = sorted(catalog_rows, key=lambda r: r["column_id"])
    primary = tuple(r["column_name"] for r in rows if flag(r, "is_primary_key"))
    unique = [r["column_name"] for r in rows if flag(r, "is_unique_key")]
    return ([KeyConstraint("primary_key", primary, True)] if primary else []) + [
        KeyConstraint(f"unique_{c}", (c,)) for c in unique]


# -- screens -----------------------------------------------------------------------------

def _spot(columns) -> Column:
    return F.pmod(F.xxhash64(*[F.col(quote_ident(c)) for c in columns]), F.lit(1 << SCREEN_BITS))


def key_screen(rows: DataFrame, columns) -> DataFrame:
    """(_part, _bits): the screen of the keys of ``rows``, 2^SCREEN_BITS bits at most."""
    return rows.select(_spot(columns).alias("_spot")).groupBy(
        F.shiftright("_spot", _ROW_BITS).alias("_part")).agg(
        F.expr(f"bitmap_construct_agg(_spot & {(1 << _ROW_BITS) - 1})").alias("_bits"))


def may_hold(df: DataFrame, columns, screen: DataFrame, flag: str) -> DataFrame:
    """``df`` with the boolean ``flag``: False where the screen has none of the row's key."""
    part, bits = f"{flag}_part", f"{flag}_bits"
    held = F.broadcast(screen.select(F.col("_part").alias(part), F.col("_bits").alias(bits)))
    spot = _spot(columns)
    byte = F.shiftright(spot.bitwiseAND(F.lit((1 << _ROW_BITS) - 1)), 3) + 1
    value = F.conv(F.hex(F.substring(F.col(bits), byte, F.lit(1))), 16, 10).cast("long")
    joined = df.join(held, F.shiftright(spot, _ROW_BITS) == F.col(part), "left")
    on = F.getbit(value, spot.bitwiseAND(F.lit(7)).cast("int")) == 1
    return joined.withColumn(flag, F.col(bits).isNotNull() & F.coalesce(on, F.lit(False))).drop(part, bits)


def _same(left: list, right: list) -> Column:
    return reduce(lambda x, y: x & y, [a.eqNullSafe(b) for a, b in zip(left, right)])


def _named(columns, prefix: str) -> list:
    return [F.col(quote_ident(c)).alias(f"{prefix}{i}") for i, c in enumerate(columns)]


def held_keys(keys: DataFrame, columns, target: DataFrame, target_columns=None) -> DataFrame:
    """The distinct keys of ``keys`` that ``target`` has too (NULLs equal), as (_k0, _k1, …).
    They are compared in the target's types; a value that does not fit one is not there. The
    target is screened in its scan: what is shuffled of it follows ``keys``."""
    theirs = target.select(*_named(target_columns or columns, "_t"))
    own, asked = [f"_k{i}" for i in range(len(columns))], [f"_m{i}" for i in range(len(columns))]
    mine = keys.select(*_named(columns, "_k")).distinct()
    for k, m, f in zip(own, asked, theirs.schema.fields):
        mine = mine.withColumn(m, F.col(k).try_cast(f.dataType)).where(F.col(m).isNotNull() | F.col(k).isNull())
    theirs = may_hold(theirs, theirs.columns, key_screen(mine, asked), "_maybe").where("_maybe").drop("_maybe").distinct()
    return mine.join(theirs, _same([F.col(c) for c in asked], [F.col(c) for c in theirs.columns]), "left_semi").select(*own)


# -- primary and unique keys ---------------------------------------------------------------

def enforce_keys(batch: DataFrame, constraints, *, order=None, existing: DataFrame | None = None):
    """(accepted, rejected): what inserting the rows of ``batch`` one by one in ``order`` would
    keep and refuse, given the rows of the target (``existing``). ``rejected`` carries
    ``failed_rules`` (names of the constraints broken, in their order) and
    ``failed_rules_text``.

    A row is refused when the target holds its key, when a primary key has a NULL, or when an
    accepted earlier row has the key; a refused row stands in nobody's way. Repeats inside the
    batch are found by a partial aggregate per key. Only rows that share a key with another
    are compared: in each round the rows that are first of all their keys are accepted and
    those that share a key with them refused, until none is left (one round for one
    constraint). Ties in ``order`` go by the place in the batch.
    """
    constraints = [c if isinstance(c, KeyConstraint) else KeyConstraint(*c) for c in constraints]
    order = [order] if isinstance(order, str) else list(order or [])
    if not constraints:
        return batch, batch.select("*", F.array().cast("array<string>").alias("failed_rules"),
                                   F.lit("").alias("failed_rules_text")).where(F.lit(False))
    rows = materialize(batch.withColumn("_row", F.monotonically_increasing_id()), "batch")
    place = F.struct(*[F.col(quote_ident(c)) for c in order], F.col("_row"))
    flagged = rows.withColumn("_place", place)
    for i, c in enumerate(constraints):
        marks = rows.groupBy(*_named(c.columns, "_k")).agg((F.count(F.lit(1)) > 1).alias(f"_many{i}")).where(f"_many{i}")
        marks = marks.withColumn(f"_held{i}", F.lit(False))
        if existing is not None:
            held = held_keys(rows, c.columns, existing).withColumn(f"_many{i}", F.lit(False)).withColumn(f"_held{i}", F.lit(True))
            keys = [f"_k{j}" for j in range(len(c.columns))]
            marks = marks.unionByName(held).groupBy(*keys).agg(F.max(f"_many{i}").alias(f"_many{i}"), F.max(f"_held{i}").alias(f"_held{i}"))
        marks = marks.select(*[F.col(f"_k{j}").alias(f"_c{i}_{j}") for j in range(len(c.columns))], f"_many{i}", f"_held{i}")
        on = _same([F.col(quote_ident(n)) for n in c.columns], [F.col(f"_c{i}_{j}") for j in range(len(c.columns))])
        flagged = flagged.join(marks, on, "left").drop(*[f"_c{i}_{j}" for j in range(len(c.columns))])
    refused = []
    for i, c in enumerate(constraints):
        broken = F.coalesce(f"_held{i}", F.lit(False))
        if c.primary:
            broken = broken | reduce(lambda x, y: x | y, [F.col(quote_ident(n)).isNull() for n in c.columns])
        refused.append(F.when(broken, F.lit(c.name)))
    shared = reduce(lambda x, y: x | y, [F.coalesce(f"_many{i}", F.lit(False)) for i in range(len(constraints))])
    flagged = flagged.withColumn("failed_rules", F.array_compact(F.array(*refused))).withColumn("_shared", shared)
    flagged = materialize(flagged.drop(*[f"_{n}{i}" for i in range(len(constraints)) for n in ("many", "held")]), "flagged")
    names = [quote_ident(c) for c in batch.columns]
    refused_now = flagged.where(F.size("failed_rules") > 0)
    accepted = flagged.where((F.size("failed_rules") == 0) & ~F.col("_shared")).select(*names)
    won, lost = _contest(flagged.where((F.size("failed_rules") == 0) & F.col("_shared")), constraints)
    rejected = refused_now.select(*names, "failed_rules")
    for w in won:
        accepted = accepted.unionByName(w.select(*names))
    for x in lost:
        rejected = rejected.unionByName(x.select(*names, "failed_rules"))
    return accepted, rejected.withColumn("failed_rules_text", F.array_join("failed_rules", ","))


def _contest(open_: DataFrame, constraints):
    """Rounds over the rows that share keys: lists of frames (accepted, refused)."""
    won, lost = [], []
    while True:
        marked = open_
        for i, c in enumerate(constraints):
            firsts = open_.groupBy(*_named(c.columns, "_f")).agg(F.min("_place").alias(f"_first{i}"))
            firsts = firsts.select(*[F.col(f"_f{j}").alias(f"_f{i}_{j}") for j in range(len(c.columns))], f"_first{i}")
            on = _same([F.col(quote_ident(n)) for n in c.columns], [F.col(f"_f{i}_{j}") for j in range(len(c.columns))])
            marked = marked.join(firsts, on).drop(*[f"_f{i}_{j}" for j in range(len(c.columns))])
        first = [F.col("_place") == F.col(f"_first{i}") for i in range(len(constraints))]
        marked = materialize(marked.withColumn("_wins", reduce(lambda x, y: x & y, first)), "round")
        winners = marked.where("_wins")
        others = marked.where("not _wins")
        if len(constraints) == 1:               # all rows of a key meet its one winner
            return won + [winners], lost + [others.withColumn("failed_rules", F.array(F.lit(constraints[0].name)))]
        # the first row of a key is in its way if it has been accepted
        ahead = winners.select(F.col("_row").alias("_w"))
        for i in range(len(constraints)):
            mine = ahead.withColumnRenamed("_w", f"_w{i}")
            others = others.join(mine, F.col(f"_first{i}._row") == F.col(f"_w{i}"), "left")
        blocked = reduce(lambda x, y: x | y, [F.col(f"_w{i}").isNotNull() for i in range(len(constraints))])
        others = others.withColumn("_blocked", blocked)
        others = materialize(others.drop(*[f"_{n}{i}" for i in range(len(constraints)) for n in ("w", "first")], "_wins"), "others")
        won.append(winners)
        lost.append(others.where("_blocked").drop("_blocked"))
        open_ = others.where("not _blocked").drop("_blocked")
        if open_.isEmpty():
            return won, [_blamed(reduce(DataFrame.unionByName, lost), reduce(DataFrame.unionByName, won), constraints)]


def _blamed(lost: DataFrame, won: DataFrame, constraints) -> DataFrame:
    """``lost`` with the names of all keys that an accepted earlier row holds (one at most
    for each key)."""
    for i, c in enumerate(constraints):
        held = won.select(*_named(c.columns, f"_h{i}_"), F.col("_place").alias(f"_by{i}"))
        on = _same([F.col(quote_ident(n)) for n in c.columns], [F.col(f"_h{i}_{j}") for j in range(len(c.columns))])
        lost = lost.join(held, on & (F.col(f"_by{i}") < F.col("_place")), "left").drop(*[f"_h{i}_{j}" for j in range(len(c.columns))])
    fails = [F.when(F.col(f"_by{i}").isNotNull(), F.lit(c.name)) for i, c in enumerate(constraints)]
    return lost.withColumn("failed_rules", F.array_compact(F.array(*fails)))


# -- foreign keys --------------------------------------------------------------------------

def _present(fk: ForeignKey) -> Column:
    return reduce(lambda x, y: x & y, [F.col(quote_ident(c)).isNotNull() for c in fk.columns])


def _screened(child: DataFrame, keys) -> DataFrame:
    """``child`` with ``_fk<i>_<j>``, its keys in the parents' types, and ``_in<i>``: whether
    the screen of the i-th parent has the key."""
    for i, fk in enumerate(keys):
        parent = fk.parent.select(*_named(fk.parent_columns, "_p"))
        own = [f"_fk{i}_{j}" for j in range(len(fk.columns))]
        child = child.select("*", *[F.col(quote_ident(c)).try_cast(f.dataType).alias(name)
                                    for c, f, name in zip(fk.columns, parent.schema.fields, own)])
        child = may_hold(child, own, key_screen(parent, parent.columns), f"_in{i}")
        fits = reduce(lambda x, y: x & y, [F.col(name).isNotNull() for name in own])
        child = child.withColumn(f"_in{i}", F.col(f"_in{i}") & fits)
    return child


def check_foreign_keys(child: DataFrame, keys) -> DataFrame:
    """The rows of ``child`` that break one of the foreign keys, with ``broken_constraints``
    (their names, in order): what restoring all constraints after a load would refuse.

    The child is read once for all constraints. Screens of the parents' keys travel to that
    scan; a row whose key is not in its screen is an orphan for sure. Of the other rows only
    the distinct keys are kept, in the same aggregate, and compared with the parents exactly.
    Should the screens have let an orphan key pass (fewer, the larger the screens), the child
    is read a second time for the rows of these keys. Constraint names are settled exactly on
    the few rows found.
    """
    keys = [k if isinstance(k, ForeignKey) else ForeignKey(*k) for k in keys]
    if not keys:
        return child.withColumn("broken_constraints", F.array().cast("array<string>")).where(F.lit(False))
    names = [quote_ident(c) for c in child.columns]
    seen = _screened(child, keys)
    sure = reduce(lambda x, y: x | y, [_present(fk) & ~F.col(f"_in{i}") for i, fk in enumerate(keys)])
    row = F.struct(*[F.col(n) for n in names])
    keyed = [F.struct(*[F.col(f"_fk{i}_{j}").alias(f"k{j}") for j in range(len(fk.columns))]) for i, fk in enumerate(keys)]

    def record(which: int, holds: Column) -> Column:
        """An orphan row (-1) or the key of one constraint; all other fields are NULL."""
        return F.when(holds, F.struct(F.lit(which).alias("fk"), F.when(F.lit(which < 0), row).alias("row"), *[
            F.when(F.lit(i == which), k).alias(f"key{i}") for i, k in enumerate(keyed)]))

    records = [record(-1, sure)] + [record(i, _present(fk) & F.col(f"_in{i}")) for i, fk in enumerate(keys)]
    found = seen.select(F.explode(F.array_compact(F.array(*records))).alias("r")).select("r.*")
    found = materialize(found.groupBy("fk", "row", *[f"key{i}" for i in range(len(keys))]).agg(F.count(F.lit(1)).alias("n")),
                        "found")
    orphans = found.where("fk < 0").select("row.*", F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))).alias("_copy")).drop("_copy")
    passed = []
    for i, fk in enumerate(keys):
        parent = fk.parent.select(*_named(fk.parent_columns, "k")).distinct()
        own = found.where(F.col("fk") == i).select(f"key{i}.*")
        on = [F.col(f"k{j}") for j in range(len(fk.columns))]
        passed.append(materialize(own.join(parent.toDF(*[f"_q{j}" for j in range(len(on))]),
                                           reduce(lambda x, y: x & y, [a == F.col(f"_q{j}") for j, a in enumerate(on)]),
                                           "left_anti"), "passed"))
    late = [(fk, p) for fk, p in zip(keys, passed) if not p.isEmpty()]
    rows = orphans
    if late:
        numbered = child.withColumn("_row", F.monotonically_increasing_id())
        hits = [numbered.join(p.toDF(*[f"_h{j}" for j in range(len(fk.columns))]),
                              reduce(lambda x, y: x & y, [F.col(quote_ident(c)) == F.col(f"_h{j}")
                                                          for j, c in enumerate(fk.columns)]), "left_semi")
                for fk, p in late]
        more = reduce(DataFrame.unionByName, hits).dropDuplicates(["_row"]).drop("_row")
        # rows with a key that the screens did refuse are among the orphans already
        rows = orphans.unionByName(_without(more, keys))
    return _settled(materialize(rows, "orphans"), keys, names)


def _without(rows: DataFrame, keys) -> DataFrame:
    """Rows without a key that a screen refuses."""
    out = _screened(rows, keys)
    kept = reduce(lambda x, y: x & y, [~_present(fk) | F.col(f"_in{i}") for i, fk in enumerate(keys)])
    return out.where(kept).select(*[quote_ident(c) for c in rows.columns])


def _settled(rows: DataFrame, keys, names) -> DataFrame:
    """Exact names of the constraints that each of ``rows`` breaks; parents are screened by
    the keys of these rows."""
    out = rows
    for i, fk in enumerate(keys):
        held = held_keys(rows.where(_present(fk)), fk.columns, fk.parent, fk.parent_columns)
        held = held.toDF(*[f"_h{i}_{j}" for j in range(len(fk.columns))]).withColumn(f"_held{i}", F.lit(True))
        on = reduce(lambda x, y: x & y, [F.col(quote_ident(c)) == F.col(f"_h{i}_{j}") for j, c in enumerate(fk.columns)])
        out = out.join(held, on, "left")
    broken = [F.when(_present(fk) & F.col(f"_held{i}").isNull(), F.lit(fk.name)) for i, fk in enumerate(keys)]
    return out.withColumn("broken_constraints", F.array_compact(F.array(*broken))).where(
        F.size("broken_constraints") > 0).select(*names, "broken_constraints")
