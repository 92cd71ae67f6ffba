"""Match transactions to bank lines in graded tiers."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from decimal import Decimal
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from payrecon.session import staged

MATCH_TYPE = "bank_match_type"
EXACT, APPROX = Decimal("0.01"), Decimal("1.00")
MONEY = "decimal(18,2)"


@dataclass(frozen=True)
class Tier:
    label: str
    auth: bool
    rrn: bool
    same_day: bool
    tolerance: Decimal

    def covers(self, other: Tier) -> bool:
        """Whether every pair of ``other`` is also a pair of this tier."""
        return (self.auth <= other.auth and self.rrn <= other.rrn and self.same_day <= other.same_day
                and self.tolerance >= other.tolerance)


# ---------------------------------------------------------------------------
# Tiers from strongest to weakest, bank columns of the view.
# ---------------------------------------------------------------------------

TIERS = (
    Tier("MATCH: Authorization Code + RRN + Amount", True, True, False, EXACT),
    Tier("MATCH: RRN + Amount", False, True, False, EXACT),
    Tier("MATCH: Authorization Code + Amount", True, False, False, EXACT),
    Tier("FALLBACK MATCH: Authorization Code + Same Day + Amount", True, False, True, EXACT),
    Tier("PARTIAL MATCH: RRN + Approx Amount", False, True, False, APPROX),
    Tier("PARTIAL MATCH: Authorization Code + Approx Amount", True, False, False, APPROX),
    Tier("PARTIAL MATCH: Authorization Code + Same Day + Approx Amount", True, False, True, APPROX),
)

BANK_COLUMNS = {
    "bank_auth_code": ("authorization_code", "string"),
    "bank_rrn": ("rrn", "string"),
    "bank_amount": ("transaction_amount", MONEY),
    "bank_transaction_date": ("transaction_date", "date"),
    "bank_transaction_type": ("transaction_type", "string"),
    "bank_status": ("status", "string"),
    "bank_bank_name": ("bank_name", "string"),
    "bank_card_type": ("card_type", "string"),
    "bank_cashback_amount": ("cashback_amount", MONEY),
    "bank_discount_amount": ("discount_amount", MONEY),
    "bank_masked_card": ("masked_card", "string"),
    "bank_merchant_identifier": ("merchant_identifier", "string"),
    "bank_payment_id": ("payment_online_transaction_id", "string"),
    "bank_posting_date": ("posting_date", "date"),
    "bank_terminal_identifier": ("terminal_identifier", "string"),
    "bank_total_payment_amount": ("total_payment_amount", MONEY),
    "bank_transaction_link_url": ("transaction_link_url", "string"),
    "bank_vat_amount": ("vat_amount", MONEY),
}

# ---------------------------------------------------------------------------


def reachable(tiers: Sequence[Tier]) -> list[Tier]:
    """Tiers that can decide a label: those not covered by a stronger (earlier) one."""
    kept: list[Tier] = []
    for tier in tiers:
        if not any(earlier.covers(tier) for earlier in kept):
            kept.append(tier)
    return kept


def bank_lines(bank: DataFrame) -> DataFrame:
    """The 18 bank columns under their names in the view."""
    return bank.select(*[F.col(source).cast(kind).alias(name) for name, (source, kind) in BANK_COLUMNS.items()])


def signature_columns(tiers: Sequence[Tier]) -> tuple[list[str], list[str]]:
    """The columns of a transaction and of a bank line that decide whether they match."""
    same_day = any(t.same_day for t in reachable(tiers))
    return (["final_rrn", "final_authorization_code", "amount", *(["transaction_date"] if same_day else [])],
            ["bank_rrn", "bank_auth_code", "bank_amount", *(["bank_transaction_date"] if same_day else [])])


def _key(column: Column, blank_keys_match: bool) -> Column:
    return column if blank_keys_match else F.nullif(column, F.lit(""))


def _cents(amount: Column) -> Column:
    return (amount * 100).cast("bigint")


def weakest(tiers: Sequence[Tier]) -> list[Tier]:
    """The tiers that no other covers: a pair matches if it reaches one of them."""
    active = reachable(tiers)
    return [t for t in active if not any(o is not t and o.covers(t) for o in active)]


def _keys(t: Tier, rrn: Column, auth: Column, day: str) -> list[Column]:
    """What the two sides of a tier's pairs have to share besides near amounts; a fixed value where the tier asks for nothing."""
    return [(rrn if t.rrn else F.lit("")).alias("_rrn"), (auth if t.auth else F.lit("")).alias("_auth"),
            (F.col(day) if t.same_day else F.lit("1970-01-01").cast("date")).alias("_day")]


def _own_keys(t: Tier, blank_keys_match: bool) -> list[Column]:
    return _keys(t, _key(F.col("final_rrn"), blank_keys_match), _key(F.col("final_authorization_code"), blank_keys_match), "transaction_date")


def _bank_keys(t: Tier) -> list[Column]:
    return _keys(t, F.col("bank_rrn"), F.col("bank_auth_code"), "bank_transaction_date")


def _reach(t: Tier) -> int:
    return int(t.tolerance * 100)


def _bucket(cents: Column, t: Tier) -> Column:
    return cents - F.pmod(cents, F.lit(max(1, 2 * _reach(t))))


def _buckets(t: Tier) -> Column:
    """A bucket is twice the tolerance wide, so a bank line belongs to two neighbouring ones and a transaction to one."""
    first = _bucket(F.col("_bank_cents") - _reach(t), t)
    return F.array(first, first + max(1, 2 * _reach(t)))


_KEYS = ["_rrn", "_auth", "_day"]
#: What a pair's two sides share. Its hash is one more key of the last join and the first: rows are sorted by the first eight bytes of
#: the first key before anything else is looked at, and of a tier's number or a code's beginning there are few.
_CELL = ["_by", *_KEYS, "_bucket", "_i", "_j"]
#: A group with more than ``BLOCK`` x ``BLOCK`` pairs is cut into blocks of a quarter of that on either side, so that its pairs are spread
#: over tasks, which are made by bytes. Each row goes to every block of the other side; so that this does not grow with the square of
#: the group, it is cut into some ``GRID`` x ``GRID`` blocks at most, which grow with it.
BLOCK, GRID = 1024, 64


def _partners(known: DataFrame, lines: DataFrame, t: Tier, by: int, blank_keys_match: bool) -> DataFrame:
    """Keys and amounts of transactions that meet bank lines in a tier, and into how many blocks of either side their pairs are cut.

    Both sides are grouped by keys and amount first, so popular or blank keys cost no product of their rows.
    """
    left = known.select(*_own_keys(t, blank_keys_match), _cents(F.col("amount")).alias("_cents"), "_n").dropna(subset=[*_KEYS, "_cents"])
    left = left.groupBy(*_KEYS, "_cents").agg(F.sum("_n").alias("_n")).withColumn("_bucket", _bucket(F.col("_cents"), t))
    right = lines.select(*_bank_keys(t), "_bank_cents").dropna(subset=[*_KEYS, "_bank_cents"])
    right = right.groupBy(*_KEYS, "_bank_cents").agg(F.count(F.lit(1)).alias("_k")).withColumn("_bucket", F.explode(_buckets(t)))
    near = F.abs(F.col("_cents") - F.col("_bank_cents")) <= _reach(t)
    met = left.join(right, [*_KEYS, "_bucket"]).where(near).groupBy(*_KEYS, "_bucket", "_cents", "_n").agg(F.sum("_k").alias("_k"))
    pairs = F.col("_n").cast("double") * F.col("_k")

    side = F.greatest(F.lit(BLOCK / 4), F.sqrt(pairs) / GRID)

    def blocks(n: str) -> Column:
        return F.when(pairs > BLOCK * BLOCK, F.ceil(F.least(F.col(n), pairs / side) / side)).otherwise(1).cast("int")

    return met.select(*[F.col(c).alias(f"_of{c}") for c in (*_KEYS, "_cents")],
                      F.struct(F.lit(by).alias("_by"), blocks("_n").alias("_a"), blocks("_k").alias("_b")).alias(f"_met{by}"))


def _same(left: DataFrame, right: DataFrame, columns: Sequence[str]) -> Column:
    return reduce(Column.__and__, [left[c].eqNullSafe(right[f"_m_{c}"]) for c in columns])


def _answers(known: DataFrame, lines: DataFrame, kinds: Sequence[Tier], own: Sequence[str], blank_keys_match: bool) -> DataFrame:
    """Every signature with the weakest tiers in which it meets bank lines: none, if it is unmatched."""
    rows = known
    for by, t in enumerate(kinds):
        met = _partners(known, lines, t, by, blank_keys_match)
        keyed = rows.withColumns({**dict(zip(_KEYS, _own_keys(t, blank_keys_match))), "_cents": _cents(F.col("amount"))})
        on = [F.col(c) == F.col(f"_of{c}") for c in (*_KEYS, "_cents")]
        rows = keyed.join(met, on, "left").select(*rows.columns, f"_met{by}")
    return rows.select(*[F.col(c).alias(f"_m_{c}") for c in own],
                       F.array_compact(F.array(*[f"_met{by}" for by in range(len(kinds))])).alias("_found"))


def _bank_entries(lines: DataFrame, answers: DataFrame, kinds: Sequence[Tier], blank_keys_match: bool) -> DataFrame:
    """Bank lines once per weakest tier, bucket and, for groups cut into blocks, block."""
    of = [F.struct(F.lit(by).alias("_by"), *_bank_keys(t), _buckets(t).alias("_buckets"), F.lit(_reach(t)).alias("_reach"))
          for by, t in enumerate(kinds)]
    entries = lines.select("*", F.inline(F.array(*of))).dropna(subset=[*_KEYS, "_bank_cents"])
    whole = entries.withColumns({"_bucket": F.explode("_buckets"), "_i": F.lit(-1), "_j": F.lit(-1)})
    # One row per group of more than BLOCK * BLOCK pairs: few, whatever the tables hold, unless the result is beyond all bounds.
    own = answers.select("*", F.inline("_found")).where("_a * _b > 1").withColumnsRenamed(
        {c: c.removeprefix("_m_") for c in answers.columns if c != "_found"})
    large = [own.where(F.col("_by") == by).select("_by", *_own_keys(t, blank_keys_match), _cents(F.col("amount")).alias("_bucket"), "_a", "_b")
             for by, t in enumerate(kinds)]
    large = reduce(DataFrame.union, large).distinct()
    cut = entries.join(F.broadcast(large), ["_by", *_KEYS]).where(F.abs(F.col("_bucket") - F.col("_bank_cents")) <= F.col("_reach")).withColumns({
        "_i": F.explode(F.sequence(F.lit(0), F.col("_a") - 1)), "_j": F.pmod(F.xxhash64(*BANK_COLUMNS), F.col("_b")).cast("int")})
    names = [*lines.columns, *_CELL]
    rows = whole.select(*names).union(cut.select(*names)).withColumn("_cell", F.xxhash64(*_CELL))
    return rows.withColumnsRenamed({c: f"_bank{c}" for c in ("_cell", *_CELL)})


def reconcile(tx: DataFrame, bank: DataFrame, tiers: Sequence[Tier] = TIERS, blank_keys_match: bool = True,
              signatures: DataFrame | None = None, derive: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
    """Left outer match of transactions to bank lines: all pairs, unmatched transactions with NULLs.

    A pair matches if it reaches one of the weakest tiers (by default: RRN, or code, within 1.00). Whether a transaction meets
    anything there follows from its signature and from counts by key and amount, so no pair is made to find that out: first the
    signatures are staged, then what each of them meets. The transactions pick that up by one inner join. Those that
    meet nothing are done; the others are listed once per weakest tier they meet and joined to the bank lines on its keys and
    an amount bucket. A pair belongs to the first weakest tier it reaches. No join follows that one, so a pair is
    never stored or shuffled, and the filters ``bank_match_type IS NULL`` and ``IS NOT NULL`` leave one of the two parts out.

    Either side of a join may be split at run time. A group of one key and amount with more than ``BLOCK * BLOCK`` pairs is cut
    into blocks before, as its rows may be few bytes and its pairs many.

    ``tx`` is evaluated narrow for the signatures and wide for the rows, and has to give the same rows every time, as
    files do. ``signatures`` may name a frame that is cheaper to evaluate and holds the signatures of ``tx``, or more.

    ``derive`` adds columns that follow from a transaction alone. They are made once per transaction, behind the join with the
    answers; above the last join they would be made once per pair.
    """
    nothing = {n: F.lit(None).cast(kind) for n, (_, kind) in BANK_COLUMNS.items()} | {MATCH_TYPE: F.lit(None).cast("string")}
    if not tiers:
        return derive(tx).withColumns(nothing)
    own, _ = signature_columns(tiers)
    active, kinds = reachable(tiers), weakest(tiers)
    lines = bank_lines(bank).withColumn("_bank_cents", _cents(F.col("bank_amount")))
    known = staged((tx if signatures is None else signatures).groupBy(*own).agg(F.count(F.lit(1)).alias("_n")), "signatures")
    answers = staged(_answers(known, lines, kinds, own, blank_keys_match), "pairs")
    rows = tx.join(answers, _same(tx, answers, own)).select(*tx.columns, "_found")
    alone = derive(rows.where(F.size("_found") == 0).drop("_found")).withColumns(nothing)

    spread = [c for c in ("gateway_order_id", "gateway_transaction_id", "status", "transaction_date") if c in tx.columns] or tx.columns
    large = F.col("_a") * F.col("_b") > 1
    met = rows.where(F.size("_found") > 0).select(*tx.columns, _cents(F.col("amount")).alias("_cents"), F.explode("_found").alias("_met"))
    met = met.select(*tx.columns, "_cents", "_met.*")

    def of_kind(column) -> Column:
        return reduce(lambda c, x: c.when(F.col("_by") == x[0], column(x[1])), list(enumerate(kinds))[1:], F.when(F.col("_by") == 0, column(kinds[0])))

    keys = {name: of_kind(lambda t, k=k: _own_keys(t, blank_keys_match)[k]) for k, name in enumerate(_KEYS)}
    met = met.withColumns({**keys, "_bucket": F.when(large, F.col("_cents")).otherwise(of_kind(lambda t: _bucket(F.col("_cents"), t))),
                           "_i": F.when(large, F.pmod(F.xxhash64(*spread), F.col("_a")).cast("int")).otherwise(-1),
                           "_j": F.explode(F.when(large, F.sequence(F.lit(0), F.col("_b") - 1)).otherwise(F.array(F.lit(-1))))})
    met = derive(met)
    # All of a transaction as one field: the join copies it as one piece for every pair, instead of column by column, and the
    # columns are taken out once, by the last projection. Where only some are wanted, Spark passes those through by themselves.
    wide = [c for c in alone.columns if c not in nothing]
    met = met.select(F.struct(*wide).alias("_tx"), *[F.col(c).alias(f"_own_{c}") for c in own],
                     "_cents", F.xxhash64(*_CELL).alias("_cell"), *_CELL)

    gap = F.abs(F.col("_cents") - F.col("_bank_cents"))

    def reaches(t: Tier) -> Column:
        parts = [gap <= _reach(t)]
        parts += [_key(F.col("_own_final_rrn"), blank_keys_match) == F.col("bank_rrn")] if t.rrn else []
        parts += [_key(F.col("_own_final_authorization_code"), blank_keys_match) == F.col("bank_auth_code")] if t.auth else []
        parts += [F.col("_own_transaction_date") == F.col("bank_transaction_date")] if t.same_day else []
        return F.coalesce(reduce(Column.__and__, parts), F.lit(False))

    on = [F.col(c) == F.col(f"_bank{c}") for c in ("_cell", *_CELL)]
    on += [gap <= of_kind(_reach_lit)]
    on += [(F.col("_by") <= by) | ~reaches(t) for by, t in enumerate(kinds[:-1])]
    # A pair in here reaches some tier, so the last label needs no test, and the column is never NULL.
    label = reduce(lambda c, t: c.when(reaches(t), t.label), active[1:-1], F.when(reaches(active[0]), active[0].label)).otherwise(
        active[-1].label) if len(active) > 1 else F.lit(active[0].label)
    found = met.join(_bank_entries(lines, answers, kinds, blank_keys_match), reduce(Column.__and__, on)).withColumn(MATCH_TYPE, label)
    return found.select(*[F.col("_tx")[c].alias(c) for c in wide], *nothing).union(alone.select(*wide, *nothing))


def _reach_lit(t: Tier) -> Column:
    return F.lit(_reach(t))


def match_summary(df: DataFrame) -> DataFrame:
    """Rows and amount by gateway and tier (NULL: unmatched)."""
    return df.groupBy("gateway_source", MATCH_TYPE).agg(
        F.count(F.lit(1)).alias("n_rows"), F.sum("amount").cast("decimal(38,2)").alias("total_amount"))


# -- summaries without pairs -----------------------------------------------------------------------------------

@dataclass(frozen=True, order=True)
class Kind:
    """Keys on which two sides are counted: RRN, authorisation code or both, on the same day or on any."""

    rrn: bool
    auth: bool
    day: bool


def tier_terms(tiers: Sequence[Tier]) -> dict[str, dict[tuple[Kind, Decimal], int]]:
    """Every tier's number of pairs as a sum of plain pair counts with signs.

    A plain count P(kind, tolerance) is the number of pairs equal in the keys of a kind within a tolerance. Pairs fall into
    cells by the keys they are equal in (RRN only, code only, both), by same day or not, and by the gap between two
    successive tolerances. A cell's size follows from plain counts by inclusion and exclusion, and all pairs of a cell
    reach the same tier first.
    """
    active = reachable(tiers)
    steps = sorted({t.tolerance for t in active})
    days = (True, False) if any(t.same_day for t in active) else (None,)
    terms: dict[str, dict[tuple[Kind, Decimal], int]] = {}
    for rrn, auth in ((True, False), (False, True), (True, True)):
        for day in days:
            for i, step in enumerate(steps):
                label = next((t.label for t in active if t.rrn <= rrn and t.auth <= auth and (not t.same_day or day)
                              and t.tolerance >= step), None)
                if label is None:
                    continue
                parts = [(rrn, auth, 1)] if rrn and auth else [(rrn, auth, 1), (True, True, -1)]
                on_day = {None: [(False, 1)], True: [(True, 1)], False: [(False, 1), (True, -1)]}[day]
                within = [(step, 1)] if i == 0 else [(step, 1), (steps[i - 1], -1)]
                own = terms.setdefault(label, {})
                for r, a, x in parts:
                    for d, y in on_day:
                        for t, z in within:
                            own[Kind(r, a, d), t] = own.get((Kind(r, a, d), t), 0) + x * y * z
    return {label: {k: c for k, c in own.items() if c} for label, own in terms.items()}


def tier_counts(tx: DataFrame, bank: DataFrame, tiers: Sequence[Tier] = TIERS, blank_keys_match: bool = True,
                by: Sequence[str] = ("gateway_source",)) -> DataFrame:
    """Rows and amount by the columns ``by`` and tier, as of the reconciled rows, but no pair is ever made.

    Both sides are grouped by the keys of a kind and the amount, with their numbers of rows; groups meet on keys and near amounts, and
    numbers are multiplied. A group meets at most the amounts within the tolerance, whatever its keys are, so blank or popular
    keys cost no product of their rows. What the tiers take from each other is settled afterwards on the few sums
    (:func:`tier_terms`). Transactions that meet nothing are the signatures left by anti joins with the groups that
    met something.
    """
    empty = F.lit(None).cast("string").alias(MATCH_TYPE)
    total = F.sum(F.col("_m") * F.col("amount")).cast("decimal(38,2)").alias("total_amount")
    columns = [*by, MATCH_TYPE, "n_rows", "total_amount"]
    own, theirs = signature_columns(tiers) if tiers else (["amount"], [])
    signatures = tx.groupBy(*by, *own).agg(F.count(F.lit(1)).alias("_m"))
    if not tiers:
        return signatures.groupBy(*by).agg(F.sum("_m").alias("n_rows"), total).select(*by, empty, "n_rows", "total_amount")
    signatures = staged(signatures, "signatures")
    terms = tier_terms(tiers)
    kinds = sorted({k for own_terms in terms.values() for k, _ in own_terms})
    steps = sorted({t for own_terms in terms.values() for _, t in own_terms})
    reach = [int(t * 100) for t in steps]
    width = max(1, 2 * reach[-1])
    any_day = F.lit("1970-01-01").cast("date")

    def sides(df: DataFrame, of: Sequence[int], rrn: Column, auth: Column, amount: str, day: str, count: Column, extra: Sequence[str]) -> DataFrame:
        entries = [F.struct(F.lit(i).alias("_kind"), (rrn if kinds[i].rrn else F.lit("")).alias("_rrn"), (auth if kinds[i].auth else F.lit("")).alias("_auth"),
                            (F.col(day) if kinds[i].day else any_day).alias("_day")) for i in of]
        rows = df.select(*extra, _cents(F.col(amount)).alias("_cents"), count.alias("_n"), F.inline(F.array(*entries))).dropna(
            subset=["_rrn", "_auth", "_day", "_cents"])
        return rows.groupBy(*extra, "_kind", "_rrn", "_auth", "_day", "_cents").agg(F.sum("_n").alias("_n"))

    def meetings(of: Sequence[int]) -> DataFrame:
        left = sides(signatures, of, _key(F.col("final_rrn"), blank_keys_match), _key(F.col("final_authorization_code"), blank_keys_match),
                     "amount", "transaction_date", F.col("_m"), by)
        right = sides(bank_lines(bank).select(*theirs), of, F.col("bank_rrn"), F.col("bank_auth_code"), "bank_amount", "bank_transaction_date",
                      F.lit(1), ())
        first = F.col("_cents") - reach[-1]
        first = first - F.pmod(first, F.lit(width))
        right = right.select("_kind", "_rrn", "_auth", "_day", F.col("_cents").alias("_bank_cents"), F.col("_n").alias("_k"),
                             F.explode(F.array(first, first + width)).alias("_bucket"))
        left = left.withColumn("_bucket", F.col("_cents") - F.pmod("_cents", F.lit(width)))
        gap = F.abs(F.col("_cents") - F.col("_bank_cents"))
        # With the bucket, which follows from the amount, as one more key the groups are where the join left them.
        group = [*by, "_kind", "_rrn", "_auth", "_day", "_bucket", "_cents"]
        met = left.join(right, ["_kind", "_rrn", "_auth", "_day", "_bucket"]).where(gap <= reach[-1]).groupBy(*group, "_n").agg(
            *[F.sum(F.when(gap <= r, F.col("_k"))).alias(f"_k{j}") for j, r in enumerate(reach)])
        return staged(met, "met")

    # Every kind shuffles all signatures and lines. Those of one day and those of any are done one after the other, so that the
    # shuffles of the first are gone when the second begins.
    parts = [[i for i, k in enumerate(kinds) if k.day == day] for day in (False, True)]
    met = reduce(DataFrame.union, [meetings(of) for of in parts if of])

    pairs = [F.col("_n").cast("decimal(38,0)") * F.coalesce(F.col(f"_k{j}"), F.lit(0)) for j in range(len(steps))]
    sums = met.groupBy(*by, "_kind").agg(
        *[F.sum(p).alias(f"_n{j}") for j, p in enumerate(pairs)], *[F.sum(p * F.col("_cents")).alias(f"_c{j}") for j, p in enumerate(pairs)])
    flat = sums.select(*by, "_kind", F.inline(F.array(*[
        F.struct(F.lit(j).alias("_step"), F.col(f"_n{j}").alias("_n"), F.col(f"_c{j}").alias("_c")) for j in range(len(steps))])))
    signs = F.array(*[
        F.struct(F.lit(label).alias(MATCH_TYPE), F.lit(kinds.index(k)).alias("_of_kind"), F.lit(steps.index(t)).alias("_of_step"), F.lit(c).alias("_sign"))
        for label, own_terms in terms.items() for (k, t), c in own_terms.items()])
    reached = flat.select("*", F.inline(signs)).where("_kind = _of_kind AND _step = _of_step").groupBy(*by, MATCH_TYPE).agg(
        F.sum(F.col("_sign") * F.col("_n")).cast("bigint").alias("n_rows"),
        (F.sum(F.col("_sign") * F.col("_c")) * F.lit(Decimal("0.01"))).cast("decimal(38,2)").alias("total_amount")).where("n_rows > 0")

    # What counts as a meeting: the weakest tiers only, as their pairs contain those of the others.
    alone = signatures.withColumn("_own_cents", _cents(F.col("amount")))
    for t in weakest(tiers):
        of_kind = met.where((F.col("_kind") == kinds.index(Kind(t.rrn, t.auth, t.same_day))) & (F.col(f"_k{steps.index(t.tolerance)}") > 0))
        of_kind = of_kind.select("_rrn", "_auth", "_day", "_cents").distinct()
        on = [alone["_own_cents"] == of_kind["_cents"]]
        on += [alone["final_rrn"] == of_kind["_rrn"]] if t.rrn else []
        on += [alone["final_authorization_code"] == of_kind["_auth"]] if t.auth else []
        on += [alone["transaction_date"] == of_kind["_day"]] if t.same_day else []
        alone = alone.join(of_kind, reduce(Column.__and__, on), "left_anti")
    alone = alone.groupBy(*by).agg(F.sum("_m").alias("n_rows"), total)
    if not by:
        alone = alone.where("n_rows IS NOT NULL")
    return reached.select(*columns).union(alone.select(*by, empty, "n_rows", "total_amount"))
