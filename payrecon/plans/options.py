"""Options of the payment query."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass
from decimal import Decimal

from payrecon.operators.reconcile import APPROX, EXACT, TIERS, Tier


@dataclass(frozen=True)
class QueryOptions:
    """Switches of the payment query; the defaults compute the plain view."""

    flavour: str = "generated"
    # result
    distinct_orders: bool = False
    limit: int | None = None
    date_range: tuple[str, str] | None = None
    # merging
    merge_auth_capture: bool = True
    use_auth_rrn: bool = True
    use_auth_code: bool = True
    # kinds and outcomes
    success_only: bool = True
    include_auth: bool = True
    include_capture: bool = True
    include_refund: bool = True
    include_void: bool = True
    partial_refunds: bool = True
    simplify_response_codes: bool = False
    # bank
    include_reconciliation: bool = True
    exact_match: bool = True
    approx_match: bool = True
    date_match: bool = True
    auth_rrn_match: bool = True
    rrn_only_match: bool = True
    auth_only_match: bool = True
    exact_tolerance: Decimal = EXACT
    approx_tolerance: Decimal = APPROX
    blank_keys_match: bool = True
    # row filters
    min_amount: Decimal | None = None
    max_amount: Decimal | None = None
    payment_method: str | None = None
    status: str | None = None
    include_duplicates: bool = True

    def excluded_kinds(self) -> list[str]:
        wanted = {"auth": self.include_auth, "capture": self.include_capture, "refund": self.include_refund,
                  "void": self.include_void}
        return [kind for kind, on in wanted.items() if not on]

    def tiers(self) -> list[Tier]:
        """The match tiers that are switched on, with the chosen tolerances."""
        kept = []
        for t in TIERS:
            exact = t.tolerance == EXACT
            by_key = self.auth_rrn_match if t.auth and t.rrn else (
                self.rrn_only_match if t.rrn else (self.date_match if t.same_day else self.auth_only_match))
            if by_key and (self.exact_match if exact else self.approx_match):
                tolerance = self.exact_tolerance if exact else self.approx_tolerance
                kept.append(Tier(t.label, t.auth, t.rrn, t.same_day, Decimal(str(tolerance))))
        return kept

    def to_json(self) -> str:
        return json.dumps(asdict(self), indent=2, default=str)

    @staticmethod
    def from_json(text: str) -> QueryOptions:
        raw = json.loads(text)
        for key in ("exact_tolerance", "approx_tolerance", "min_amount", "max_amount"):
            if raw.get(key) is not None:
                raw[key] = Decimal(str(raw[key]))
        if raw.get("date_range") is not None:
            raw["date_range"] = tuple(raw["date_range"])
        return QueryOptions(**raw)
