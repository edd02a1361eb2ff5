"""Which classes are scored, and settings that are checked before anything runs."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.scoring import BANDS, CORROBORATION, MODERATE_ABOVE

Anchors = Mapping[str, tuple[float, float]]


@dataclass(frozen=True)
class ScorerSpec:
    """A class: ``apply`` adds a column of its name (a struct of score and subs, or null) to rows of transactions, by anchors that settings may
    give for the features in ``anchors``. ``allow`` names what settings may list as harmless; ``allowed`` gives the lists of a row."""

    name: str
    apply: Callable[[DataFrame, Anchors], DataFrame]
    anchors: tuple[str, ...] = ()
    allow: tuple[str, ...] = ()


#: class -> what is listed -> network -> the list
AllowLists = Mapping[str, Mapping[str, Mapping[str, Sequence[str]]]]

# Beginnings of addresses of contracts that settle in batches, and policies of collections that move in bulk.
ALLOWED: AllowLists = {
    "multiple_sat": {
        "prefixes": {
            "mainnet": ("addr1w9zsmyfc5tg49ng9gqaetm8qheyheemxakq47x7qfwnq5wq", "addr1z8snz7c4974vzdpxu65ruphl3zjdvtxw8strf2c2tmqnxz", "addr1wyx22z2s4kasd3w976pnjf9xdty88epjqfvgkmfnfpcsgh"),
            "preprod": ("addr_test1wzpzd7k0lkpkr3kh460ll6c88r4p5nhqehu3gjtc359a2ds9qpd7c",),
        }
    },
    "token_dust": {
        "policies": {
            "mainnet": (
                "14296258677a869366d6bb01568f31f7b2e690208739b7bcdca444b2", "94ec588251e710b7660dfd7765f08c87742a3012cce802897a3ebd28", "afa1a5285da6f5c0708c30315ef9afc2ee8b891bda171b8c25017bc5",
                "99b750541529ba5cc684f9e1d43911c68913128d45a7004d9344343b", "55daa23e0e243bb4dda613c9d06a78da955f26160b13320999f912e2",
            )
        }
    },
}


def with_allowed(rows: DataFrame, lists: AllowLists) -> DataFrame:
    """``rows`` (network) with the allow-lists of their network, where there are any."""
    for name, kinds in lists.items():
        for kind, own in kinds.items():
            if any(own.values()):
                known = F.create_map(*[x for n, values in own.items() for x in (F.lit(n), F.array(*map(F.lit, values)).cast("array<string>"))])
                rows = rows.withColumn(f"_allow_{name}_{kind}", F.coalesce(F.try_element_at(known, F.col("network")), F.array().cast("array<string>")))
    return rows


def allowed(rows: DataFrame, name: str, kind: str) -> Column:
    """A class's list for each row of ``with_allowed``; empty where there is none."""
    column = f"_allow_{name}_{kind}"
    return F.col(column) if column in rows.columns else F.array().cast("array<string>")


@dataclass(frozen=True)
class Settings:
    """Classes that are switched off, anchors (median and 99th percentile) by class and feature, the bands from the highest on
    with their least scores, the score above which the lowest named band begins, and the score from which a class bears another out.
    ``allow`` takes the place of the allow-lists of the classes it names, by network."""

    off: frozenset[str] = frozenset()
    anchors: Mapping[str, Anchors] = field(default_factory=dict)
    bands: tuple[tuple[str, float], ...] = BANDS
    moderate_above: float = MODERATE_ABOVE
    corroboration: float = CORROBORATION
    allow: AllowLists = field(default_factory=lambda: ALLOWED)


def settings(given: Mapping, specs: Sequence[ScorerSpec]) -> Settings:
    """Settings from a mapping such as a file holds. All that is wrong with them is told at once: names that nothing has, classes that
    aren't there, anchors that don't spread, bands that don't descend or leave 0 to 100, lists that aren't lists of text."""
    wrong: list[str] = []
    known = {s.name: s for s in specs}
    if len(known) != len(specs):
        wrong.append("two classes have one name")
    wrong += [f"unknown setting {k!r}" for k in given if k not in Settings.__dataclass_fields__]
    off = frozenset(given.get("off", ()))
    wrong += [f"off: unknown class {c!r}" for c in sorted(off - set(known))]
    anchors: dict[str, dict[str, tuple[float, float]]] = {}
    for c, own in given.get("anchors", {}).items():
        if c not in known:
            wrong.append(f"anchors: unknown class {c!r}")
            continue
        for f, pair in own.items():
            if f not in known[c].anchors:
                wrong.append(f"anchors of {c}: unknown feature {f!r}")
            elif not (isinstance(pair, (list, tuple)) and len(pair) == 2 and all(isinstance(x, (int, float)) and x == x for x in pair) and pair[0] < pair[1]):
                wrong.append(f"anchors of {c}, {f}: a median and a larger 99th percentile are wanted, not {pair!r}")
            else:
                anchors.setdefault(c, {})[f] = (float(pair[0]), float(pair[1]))
    allow = dict(ALLOWED)
    for c, kinds in given.get("allow", {}).items():
        if c not in known:
            wrong.append(f"allow: unknown class {c!r}")
            continue
        for kind, own in kinds.items():
            if kind not in known[c].allow:
                wrong.append(f"allow of {c}: unknown list {kind!r}")
            # an empty beginning would let every address pass
            wrong += [f"allow of {c}, {kind}, {n}: a list of texts that aren't empty is wanted" for n, v in own.items() if isinstance(v, str) or not all(isinstance(x, str) and x for x in v)]
        allow[c] = kinds
    bands = tuple((str(n), float(v)) for n, v in given.get("bands", BANDS))
    moderate, corroboration = float(given.get("moderate_above", MODERATE_ABOVE)), float(given.get("corroboration", CORROBORATION))
    steps = [v for _, v in bands] + [moderate]
    if not bands or any(a <= b for a, b in zip(steps, steps[1:])) or steps[0] > 100 or steps[-1] < 0:
        wrong.append(f"bands must descend between 100 and 0, not {steps}")
    if len({n for n, _ in bands}) < len(bands):
        wrong.append("two bands have one name")
    if not 0 <= corroboration <= 100:
        wrong.append(f"corroboration must lie between 0 and 100, not {corroboration:g}")
    if wrong:
        raise ValueError("; ".join(wrong))
    return Settings(off, anchors, bands, moderate, corroboration, allow)
