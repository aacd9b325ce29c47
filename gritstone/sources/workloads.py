"""Workload files: query texts, parameter sets for search and held-out phases, and manifests that name them.

Values are drawn with a seeded generator, so a workload can be made again; the domains follow the tables at hand rather
than a standard's. Search and held-out sets are disjoint by id and, where the domain allows, by value.
"""

from __future__ import annotations

import datetime as dt
import json
import random
from collections.abc import Callable
from dataclasses import asdict, dataclass
from hashlib import sha256
from pathlib import Path

from gritstone.operators.equivalence import ParameterSet
from gritstone.sources.templates import ALL, ANTI_PATTERNS, PREVIOUS_ROW_TEMPLATE, TPCH, Template

# How many parameter sets, from which seeds, and the names of fields and selectors in the files.
SEARCH_SETS, HELD_OUT_SETS = 70, 30
TPCH_SEED, ANTI_PATTERN_SEED = 20260506, 20260512
JOIN_ORDER_SETS = (30, 30)


@dataclass(frozen=True)
class ManifestEntry:
    """One case of a workload."""

    query_file: str
    parameter_file: str
    held_out_parameter_file: str | None
    expected_candidate_source_detail: str
    workload_label: str
    workload_description: str


@dataclass(frozen=True)
class Domains:
    """Values that parameters are drawn from."""

    nations: tuple[str, ...] = tuple(f"NATION_{i}" for i in range(25))
    regions: tuple[str, ...] = ("AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST")
    segments: tuple[str, ...] = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")
    modes: tuple[str, ...] = ("REG AIR", "AIR", "RAIL", "SHIP", "TRUCK", "MAIL", "FOB")
    types: tuple[str, ...] = ("STANDARD", "SMALL", "MEDIUM", "LARGE", "ECONOMY", "PROMO")
    brands: tuple[str, ...] = tuple(f"Brand#{i}" for i in range(1, 26))
    containers: tuple[str, ...] = ("SM CASE", "SM BOX", "MED BAG", "MED BOX", "LG CASE", "LG PACK")
    priorities: tuple[str, ...] = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")
    words: tuple[str, ...] = ("special", "final", "plain")
    nouns: tuple[str, ...] = ("requests", "deposits", "packages")
    names: tuple[str, ...] = ("ring", "small", "large", "blue", "green")
    first: dt.date = dt.date(1995, 1, 1)
    last: dt.date = dt.date(2001, 8, 1)

    def day(self, rng: random.Random) -> dt.date:
        return self.first + dt.timedelta(days=rng.randint(0, (self.last - self.first).days - 120))

    def year(self, rng: random.Random) -> dt.date:
        return dt.date(rng.randint(self.first.year, self.last.year - 1), 1, 1)

    def quarter(self, rng: random.Random) -> dt.date:
        return dt.date(rng.randint(self.first.year, self.last.year - 1), rng.choice((1, 4, 7, 10)), 1)

    def span(self, rng: random.Random, *days: int) -> tuple[dt.date, dt.date]:
        begin = self.day(rng)
        return begin, begin + dt.timedelta(days=rng.choice(days))


Draw = Callable[[Domains, random.Random], tuple]
DRAWS: dict[str, Draw] = {
    "tpch_q01": lambda d, r: (d.last - dt.timedelta(days=r.randint(60, 900)),),
    "tpch_q02": lambda d, r: (r.randint(1, 50), r.choice(d.types), r.choice(d.regions)),
    "tpch_q03": lambda d, r: (r.choice(d.segments), d.day(r)),
    "tpch_q04": lambda d, r: (d.quarter(r),),
    "tpch_q05": lambda d, r: (r.choice(d.regions), d.year(r)),
    "tpch_q06": lambda d, r: (d.year(r), f"{r.randint(2, 9) / 100:.2f}", r.randint(24, 26)),
    "tpch_q07": lambda d, r: tuple(r.sample(d.nations, 2)),
    "tpch_q08": lambda d, r: (r.choice(d.nations), r.choice(d.regions), r.choice(d.types)),
    "tpch_q09": lambda d, r: (r.choice(d.names),),
    "tpch_q10": lambda d, r: (d.quarter(r),),
    "tpch_q11": lambda d, r: (r.choice(d.nations), f"{r.randint(1, 9) / 10000:.4f}"),
    "tpch_q12": lambda d, r: (*r.sample(d.modes, 2), d.year(r)),
    "tpch_q13": lambda d, r: (r.choice(d.words), r.choice(d.nouns)),
    "tpch_q14": lambda d, r: (dt.date(r.randint(d.first.year, d.last.year - 1), r.randint(1, 12), 1),),
    "tpch_q15": lambda d, r: (d.quarter(r),),
    "tpch_q16": lambda d, r: (r.choice(d.brands), r.choice(d.types), *r.sample(range(1, 51), 8)),
    "tpch_q17": lambda d, r: (r.choice(d.brands), r.choice(d.containers)),
    "tpch_q18": lambda d, r: (r.randint(200, 300),),
    "tpch_q19": lambda d, r: (r.choice(d.brands), r.randint(1, 10), r.choice(d.brands), r.randint(10, 20), r.choice(d.brands), r.randint(20, 30)),
    "tpch_q20": lambda d, r: (r.choice(d.names), d.year(r), r.choice(d.nations)),
    "tpch_q21": lambda d, r: (r.choice(d.nations),),
    "tpch_q22": lambda d, r: tuple(str(c) for c in r.sample(range(10, 35), 7)),
    "rw_01": lambda d, r: (r.choice(d.brands), r.randint(5, 25)),
    "rw_02": lambda d, r: (f"{r.randint(1500, 3500) * 100}", r.choice(("F", "O", "P"))),
    "rw_03": lambda d, r: d.span(r, 30, 60, 90),
    "rw_04": lambda d, r: (r.choice(d.priorities), r.choice(d.modes), r.randint(40, 48)),
    "rw_05": lambda d, r: (r.choice(d.brands), r.choice(d.nations), f"{r.randint(3, 9) / 100:.2f}"),
    "rw_06": lambda d, r: (r.choice(("F", "O")), r.choice(d.modes), r.randint(10, 200)),
    "rw_07": lambda d, r: (r.randint(0, 8000), r.randint(0, 4)),
    "rw_08": lambda d, r: (r.choice(d.segments),),
    "rw_09": lambda d, r: (r.randint(1, 2000),),
    "rw_10": lambda d, r: (*r.sample(d.priorities, 2), d.day(r)),
}


def parameter_sets(template: Template, phase: str, count: int, rng: random.Random, domains: Domains = Domains(), taken: set | None = None) -> list[ParameterSet]:
    """``count`` drawn sets; values in ``taken`` are drawn again, as long as the domain yields others."""
    out, taken = [], taken if taken is not None else set()
    for i in range(1, count + 1):
        for _ in range(20):
            values = DRAWS[template.name](domains, rng)
            if values not in taken:
                break
        taken.add(values)
        told = tuple((f"${n}", t, v.isoformat() if isinstance(v, dt.date) else v) for n, (t, v) in enumerate(zip(template.types, values), 1))
        out.append(ParameterSet(f"{template.name}-{phase}-{i:03}", told))
    return out


def _json(path: Path, value) -> None:
    path.write_text(json.dumps(value, indent=2) + "\n", encoding="utf-8")


SELECTORS = {"baseline": "baseline-only", "rule": "first-rule-candidate", "model": "first-llm-candidate", "mixed": "candidate-pool"}


def _write(root: Path, kind: str, cases: list[tuple[Template, list[ParameterSet], list[ParameterSet]]], fixed: str = "parameterized") -> list[Path]:
    (root / "queries").mkdir(parents=True, exist_ok=True)
    (root / "parameters").mkdir(parents=True, exist_ok=True)
    made = []
    for t, search, held in cases:
        made += [root / "queries" / f"{t.name}.sql", root / "parameters" / f"{t.name}.search.json", root / "parameters" / f"{t.name}.held-out.json"]
        made[-3].write_text(t.sql.rstrip(";") + ";\n", encoding="utf-8")
        _json(made[-2], [s.to_json() for s in search])
        _json(made[-1], [s.to_json() for s in held])
    for name, selector in SELECTORS.items():
        entries = [ManifestEntry(f"queries/{t.name}.sql", f"parameters/{t.name}.search.json", f"parameters/{t.name}.held-out.json", selector, f"{t.name}_{fixed}", f"{kind} {t.name}, {len(s)} search and {len(h)} held-out sets") for t, s, h in cases]
        made.append(root / f"{kind}-{name}.json")
        _json(made[-1], [asdict(e) for e in entries])
    _json(root / f"{kind}-files.json", {p.relative_to(root).as_posix(): sha256(p.read_bytes()).hexdigest() for p in made})
    return [*made, root / f"{kind}-files.json"]


def _drawn(templates: list[Template], seed: int, search: int, held: int, domains: Domains) -> list[tuple[Template, list[ParameterSet], list[ParameterSet]]]:
    rng, out = random.Random(seed), []
    for t in templates:
        taken: set = set()
        out.append((t, parameter_sets(t, "search", search, rng, domains, taken), parameter_sets(t, "held-out", held, rng, domains, taken)))
    return out


def write_tpch(root: str | Path, search: int = SEARCH_SETS, held: int = HELD_OUT_SETS, seed: int = TPCH_SEED, domains: Domains = Domains()) -> list[Path]:
    return _write(Path(root), "tpch", _drawn(TPCH, seed, search, held, domains))


def write_anti_patterns(root: str | Path, search: int = SEARCH_SETS, held: int = HELD_OUT_SETS, seed: int = ANTI_PATTERN_SEED, domains: Domains = Domains()) -> list[Path]:
    templates = [t for t in ANTI_PATTERNS if t.name < "rw_09"] + [PREVIOUS_ROW_TEMPLATE, ALL["rw_10"]]
    return _write(Path(root), "real-world", _drawn(templates, seed, search, held, domains))


def write_join_order(root: str | Path, folder: str | Path, only: set[str] | None = None, sets: tuple[int, int] = JOIN_ORDER_SETS) -> list[Path]:
    """Cases for query files named like ``17b.sql``, which have fixed literals: their parameter sets are empty."""
    found = sorted((p for p in Path(folder).glob("*.sql") if p.stem[:-1].isdigit() and p.stem[-1:].isalpha()), key=lambda p: (int(p.stem[:-1]), p.stem[-1]))
    if only is not None:
        missing = only - {p.stem for p in found}
        if missing:
            raise ValueError(f"no query files for {sorted(missing)}")
        found = [p for p in found if p.stem in only]
    empty = lambda name, phase, n: [ParameterSet(f"{name}-{phase}-{i:03}") for i in range(1, n + 1)]
    cases = [(Template(f"job_imdb_{p.stem}", p.read_text(), (), ()), empty(p.stem, "search", sets[0]), empty(p.stem, "held-out", sets[1])) for p in found]
    return _write(Path(root), "job-imdb", cases, "fixed_literal")


def read_manifest(path: str | Path) -> list[ManifestEntry]:
    return [ManifestEntry(**{"held_out_parameter_file": None} | x) for x in json.loads(Path(path).read_text())]


def read_parameter_sets(path: str | Path) -> list[ParameterSet]:
    return [ParameterSet.from_json(x) for x in json.loads(Path(path).read_text())]


def reduce_manifest(entries: list[ManifestEntry], most: int | None) -> list[ManifestEntry]:
    """The first so many cases; all of them without a number."""
    if most is not None and most < 1:
        raise ValueError("a reduced workload keeps at least one case")
    return entries[:most]
