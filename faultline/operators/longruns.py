"""Runs larger than a task: parts of an output, each read on its own.

A run's readers (parse.py) are machines whose modes decide what a line means, so a part
can't be read before it is known how the part before it ended. Four steps:

1. Each part is read from every combination of modes that it may start in. A mode is left
   open until a line depends on it, and machines that come to equal modes go on as one,
   which most do within a few lines. What a part does
   to the readers is kept as effects: the modes it ends in, and what it leaves in their
   registers (open blocks, symbols, pending headers), in terms of what they held before.
2. Effects are composed. Composing is associative, so neighbouring parts are joined in
   groups of FAN, and groups again, until one effect is left for each run.
3. Going back down, each part gets the readers' state where it begins.
4. Each part is read again, now for its frames, errors and so on, and a run's results are
   put together in order.

No task holds more than FAN parts, but for the last step of parse_parts, which makes one
row of a run's results; frames_of_parts makes a row of each frame. A run's lines may be cut into parts anywhere between two lines.
"""

from __future__ import annotations

import itertools
import pickle
from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from faultline.operators import scan
from faultline.operators.parse import _TYPES, COMPILERS, FRAME, PARSED_DDL, RUST, TRACEBACK, Go, Machine, Rust, Sheet, folded, marks, parse_runs, report, stirs
from faultline.sources.staging import staged

#: Characters of a part, and parts (or groups of them) that are composed in one task.
PART, FAN = 4_000_000, 64


class In(NamedTuple):
    """What a register held before."""

    name: str


class New(NamedTuple):
    """A block opened since: the number of blocks opened before it, for certain and by the first conditions."""

    sure: int
    conditions: int


class Either(NamedTuple):
    """The block that a condition opened; if it wasn't met, what the register held before."""

    condition: int
    name: str


class Condition(NamedTuple):
    """A block opened only if the register held none, after so many certain ones."""

    name: str
    sure: int


class Effect(NamedTuple):
    """What some lines do to the readers."""

    modes: tuple
    registers: dict
    opened: int
    conditions: tuple
    diagnostics: int


#: Registers that hold a block, and the others.
_BLOCKS = ("cpython", "pytest", "rust", "go", "go_test", "jvm", "compilers", "node")
_OTHERS = ("link", "rust_symbol", "go_symbol", "told", "unlabelled", "touching")
#: (level, is a diagnostic's label awaited?); the level of a header that may come to nothing; modes of the others.
_LEVELS = [(None, False), ("warning", False), ("error", False), ("error", True)]
MODES = list(itertools.product(("idle", "body"), ("idle", "backtrace", "awaiting"), ("idle", "goroutine"), _LEVELS, (None, "warning", "error")))
START = Effect(("idle", "idle", "idle", (None, False), None), {**dict.fromkeys(_BLOCKS), "link": "", "rust_symbol": None, "go_symbol": None, "told": None, "unlabelled": None, "touching": False}, 0, (), 0)


class Trace(Sheet):
    """A sheet that keeps only which blocks are opened."""

    def __init__(self) -> None:
        super().__init__()
        self.opened, self.conditions, self.told = 0, [], 0
        self.frames = self.errors = {"direct": _Nothing(), "late": _Nothing()}
        self.explained = self.tests = self.test_names = self.causes = self.labels = _Nothing()
        self.endings = _Nothing()

    def open(self, *_) -> New:
        self.opened += 1
        return New(self.opened - 1, len(self.conditions))

    def sure(self, block, reader: str, *_):
        if isinstance(block, In):
            self.conditions.append(Condition("touching" if reader == "node" else reader, self.opened))
            return Either(len(self.conditions) - 1, reader)
        return self.open() if block is None else block

    def diagnose(self, _) -> int:
        self.told += 1
        return self.told - 1

    def frame(self, *_, **__) -> None:
        pass


class _Nothing(list):
    def append(self, _) -> None:
        pass

    def __setitem__(self, *_) -> None:
        pass


def _load(machine: Machine, modes: tuple, registers: dict) -> Machine:
    """Readers in the given modes, with registers as Python values (or In, in a trace)."""
    m = machine
    m.cpython.turn(modes[0])
    m.rust.turn(modes[1])
    m.go.turn(modes[2])
    level, awaited = modes[3]
    m.compilers.level, m.compilers.unlabelled = level, registers["unlabelled"] if awaited else None
    m.compilers.pending, m.compilers.busy = (modes[4], registers["told"]) if modes[4] else None, bool(modes[4])
    m.cpython.link, m.rust.symbol, m.go.symbol = registers["link"], registers["rust_symbol"], registers["go_symbol"]
    m.cpython.block, m.pytest.block, m.rust.block, m.go.block, m.go.test, m.jvm.block, m.compilers.block, m.node.block = (registers[r] for r in _BLOCKS)
    m.node.last = None if isinstance(registers["touching"], In) else -1 if registers["touching"] else -2
    return m


def _modes(m: Machine) -> tuple:
    c = m.compilers
    return m.cpython.mode, m.rust.mode, m.go.mode, (c.level, c.unlabelled is not None), c.pending and c.pending[0]


def _effect(m: Machine, n_lines: int) -> Effect:
    c = m.compilers
    held = (m.cpython.block, m.pytest.block, m.rust.block, m.go.block, m.go.test, m.jvm.block, c.block, m.node.block)
    touching = In("touching") if not n_lines else m.node.last == n_lines - 1
    others = (m.cpython.link, m.rust.symbol, m.go.symbol, c.pending and c.pending[1], c.unlabelled, touching)
    return Effect(_modes(m), dict(zip(_BLOCKS + _OTHERS, held + others, strict=True)), m.sheet.opened, tuple(m.sheet.conditions), m.sheet.told)


def compose(a: Effect, b: Effect) -> Effect:
    """b after a; b must be one for the modes that a ends in."""
    conditions, fates, always = list(a.conditions), [], []
    for c in b.conditions:
        held = a.registers[c.name]
        block = "node" if c.name == "touching" else c.name
        if isinstance(held, In):
            conditions.append(Condition(held.name, a.opened + c.sure + len(always)))
            fates.append(Either(len(conditions) - 1, block))
        elif held is None or held is False:
            always.append(len(fates))
            fates.append(New(a.opened + c.sure + len(always) - 1, len(conditions)))
        else:
            fates.append(a.registers[block])

    def carried(name: str, value):
        if isinstance(value, In):
            return a.registers[value.name]
        if isinstance(value, Either):
            return fates[value.condition]
        if isinstance(value, New):
            before = fates[: value.conditions]
            kept = sum(isinstance(f, Either) and f.condition >= len(a.conditions) for f in before)
            return New(a.opened + value.sure + sum(k < value.conditions for k in always), len(a.conditions) + kept)
        return value + a.diagnostics if name == "unlabelled" and value is not None else value

    registers = {name: carried(name, value) for name, value in b.registers.items()}
    return Effect(b.modes, registers, a.opened + b.opened + len(always), tuple(conditions), a.diagnostics + b.diagnostics)


#: What a reader's mode may be while that is left open; the reader goes on as with the first of them.
OPEN = (("idle", "body"), ("idle", "backtrace"), ("idle", "goroutine"), tuple(_LEVELS))
_CPYTHON, _RUST, _GO, _LEVEL = range(4)
_SAME = {modes: modes for modes in MODES}


class Live(NamedTuple):
    """A machine, the modes of a part's start that it stands for, and the readers whose modes are left open."""

    starts: list
    machine: Machine
    open: frozenset


def _matches(scanners: list, line: str) -> bool:
    return any(found is not None and found is not False for found in (scanner(line) for scanner, _ in scanners))


def _asked(live: Live, line: str, found: int, stirring: bool) -> set:
    """Those of the open modes on which the line's meaning may depend."""
    asked = set()
    if _CPYTHON in live.open and TRACEBACK not in line:
        asked.add(_CPYTHON)
    if _RUST in live.open and (found & RUST or (stirring and _matches(Rust._inside, line))):
        asked.add(_RUST)
    if _GO in live.open and stirring and _matches(Go._inside, line):
        asked.add(_GO)
    if _LEVEL in live.open and (found & COMPILERS or live.machine.compilers.busy) and (scan.rustc_span(line) or scan.rustc_header(line) or scan.rustc_label(line)):
        asked.add(_LEVEL)
    return asked


def effects_of(text: str) -> dict[tuple, Effect]:
    """What a part does, for each combination of modes that it may start in.

    A reader's mode is left open until a line's meaning depends on it, so few machines are
    needed at a time. Effects that share their registers differ by modes only.
    """
    unknown = {r: In(r) for r in _BLOCKS + _OTHERS}
    kinds = {(told, label): {**unknown, "told": In("told") if told else None, "unlabelled": In("unlabelled") if label else None} for told in (False, True) for label in (False, True)}
    done = {modes: Effect(modes, kinds[modes[4] is not None, modes[3][1]], 0, (), 0) for modes in MODES}

    def fresh(starts: list[tuple], left: frozenset) -> Live:
        now = done[starts[0]].modes
        modes = tuple(OPEN[k][0] if k in left else mode for k, mode in enumerate(now))
        return Live(starts, _load(Machine(Trace()), modes, unknown), left)

    def close(live: Live, n_lines: int) -> None:
        effect = _effect(live.machine, n_lines)
        if _LEVEL in live.open:
            effect = effect._replace(registers={**effect.registers, "unlabelled": In("unlabelled")})
        made: dict[int, Effect] = {}
        for modes in live.starts:
            before = done[modes]
            if id(before.registers) not in made:
                after = compose(before, effect)
                made[id(before.registers)] = held.setdefault((tuple(after.registers.values()), *after[2:]), after)
        for modes in live.starts:
            before = done[modes]
            now = tuple(b if k in live.open else e for k, (b, e) in enumerate(zip(before.modes, effect.modes, strict=True)))
            done[modes] = made[id(before.registers)]._replace(modes=_SAME[now])

    alike: dict[tuple, list] = {}
    for modes in MODES:
        alike.setdefault((modes[_RUST] == "awaiting", modes[4]), []).append(modes)
    every = frozenset(range(4))
    held: dict[tuple, Effect] = {}  # equal effects as one, but for their modes
    running = [fresh(starts, every - {_RUST} if awaiting else every) for (awaiting, _), starts in alike.items()]
    since = 0  # line at which the running machines began

    lines = text.splitlines()
    for number, line in enumerate(lines):
        found, stirring, turned = marks(line), stirs(line), False
        asked = [_asked(live, line, found, stirring) for live in running]
        if any(asked):
            groups = []
            for live, wanted in zip(running, asked, strict=True):
                if number > since:
                    close(live, number - since)
                parted: dict[tuple, list] = {}
                for modes in live.starts:
                    parted.setdefault(tuple(done[modes].modes[k] for k in wanted), []).append(modes)
                groups += [(starts, live.open - wanted) for starts in parted.values()]
            running, since = [fresh(*g) for g in groups], number
        for at, (starts, machine, left) in enumerate(running):
            if found or machine.alert() or (stirring and machine.inside()):
                before = _modes(machine)
                machine.read(number - since, line, found)
                now = _modes(machine)
                if now != before:
                    turned = True
                    running[at] = Live(starts, machine, left - {k for k in left if now[k] != before[k]})
        if turned and len(running) > 1:
            met: dict[tuple, list] = {}
            for live in running:
                met.setdefault((_modes(live.machine), live.open), []).append(live)
            if len(met) < len(running):
                for live in running:
                    close(live, number + 1 - since)
                running = [fresh([modes for live in group for modes in live.starts], left) for (_, left), group in met.items()]
                since = number + 1
    if len(lines) > since:
        for live in running:
            close(live, len(lines) - since)
    return done


def joined(parts: list[dict[tuple, Effect]]) -> dict[tuple, Effect]:
    """The effects of parts that follow one another; those that share their registers are composed once."""
    whole = parts[0]
    for part in parts[1:]:
        made: dict[tuple, Effect] = {}
        after = {}
        for modes, effect in whole.items():
            then = part[effect.modes]
            pair = id(effect.registers), id(then.registers)
            if pair not in made:
                made[pair] = compose(effect, then)
            after[modes] = made[pair]._replace(modes=then.modes)
        whole = after
    return whole


def read_part(text: str, start: Effect) -> Sheet:
    """What a part shows when the readers begin as `start` says; block and diagnostic numbers are the run's."""

    def number(value):
        return value.sure if isinstance(value, New) else value

    sheet = Sheet()
    sheet.first_block, sheet.first_diagnostic = start.opened, start.diagnostics
    machine = _load(Machine(sheet), start.modes, {name: number(value) for name, value in start.registers.items()})
    for at, line in enumerate(text.splitlines()):
        machine.offer(at, line)
    return sheet


def whole_sheet(sheets: list[Sheet]) -> Sheet:
    """The sheets of all parts as one."""
    whole = Sheet()
    for s in sheets:
        for family in ("direct", "late"):
            whole.frames[family] += s.frames[family]
            whole.errors[family] += s.errors[family]
        for name in ("blocks", "explained", "tests", "test_names", "causes", "diagnostics", "labels"):
            getattr(whole, name).extend(getattr(s, name))
        whole.endings.update(s.endings)
    return whole


_KEPT = ("frames", "errors", "blocks", "explained", "tests", "test_names", "causes", "diagnostics", "labels", "endings")


def _packed(value) -> bytes:
    return pickle.dumps(value, pickle.HIGHEST_PROTOCOL)


def _summaries(batches):
    for batch in batches:
        made = [_packed(effects_of(t or "")) for t in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("run_id"), batch.column("at"), pa.array(made, pa.binary())], names=["run_id", "at", "effects"])


def _up(group: pd.DataFrame) -> pd.DataFrame:
    """A group of neighbours as one."""
    group = group.sort_values("at")
    return pd.DataFrame({"run_id": group.run_id.iloc[:1], "at": group["at"].iloc[:1], "effects": [_packed(joined([pickle.loads(e) for e in group.effects]))]})


def _down(group: pd.DataFrame) -> pd.DataFrame:
    """The state at which each of a group of neighbours begins; `start` is the group's own, at its first row."""
    group = group.sort_values("at")
    now, starts = pickle.loads(group.start.dropna().iloc[0]), []
    for effects in group.effects:
        starts.append(_packed(now))
        now = compose(now, pickle.loads(effects)[now.modes])
    return pd.DataFrame({"run_id": group.run_id, "at": group["at"], "start": starts})


def _read(batches):
    for batch in batches:
        made = []
        for text, start in zip(batch.column("text").to_pylist(), batch.column("start").to_pylist(), strict=True):
            sheet = read_part(text or "", pickle.loads(start))
            told = {k: getattr(sheet, k) for k in _KEPT}
            some = any(any(v.values()) if k in ("frames", "errors") else v for k, v in told.items())
            made.append(_packed(told) if some else None)
        yield pa.RecordBatch.from_arrays([batch.column("run_id"), batch.column("at"), pa.array(made, pa.binary())], names=["run_id", "at", "shown"])


def _together(batches):
    for batch in batches:
        rows = []
        for shown in batch.column("shown").to_pylist():
            sheets = []
            for one in shown:
                sheet = Sheet()
                sheet.__dict__.update(pickle.loads(one["shown"]))
                sheets.append(sheet)
            rows.append(report(whole_sheet(sheets)))
        yield pa.RecordBatch.from_arrays([batch.column("run_id"), *(pa.array([r[k] for r in rows], kind) for k, kind in _TYPES.items())], names=["run_id", *_TYPES])


def _begun(parts: DataFrame, spacing: int) -> DataFrame:
    """run_id, at, text, start: the parts with the state at which each begins."""
    parts = parts.select(F.col("run_id").cast("long").alias("run_id"), F.col("at").cast("long").alias("at"), "text")
    ddl = "run_id long, at long, effects binary"
    levels = [staged(parts.mapInArrow(_summaries, ddl))]
    span = spacing
    while True:
        span *= FAN
        most = levels[-1].groupBy("run_id").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0]
        if most is None or most <= FAN:
            break
        levels.append(staged(levels[-1].groupBy("run_id", F.floor(F.col("at") / span).alias("g")).applyInPandas(_up, ddl)))
    begin = F.lit(bytearray(_packed(START)))
    starts = levels[-1].withColumn("first", F.min("at").over(Window.partitionBy("run_id"))).select("run_id", "at", "effects", F.when(F.col("at") == F.col("first"), begin).alias("start"), F.lit(0).alias("g"))
    for k in range(len(levels) - 1, -1, -1):
        began = starts.groupBy("run_id", "g").applyInPandas(_down, "run_id long, at long, start binary")
        if k:
            span //= FAN
            below = levels[k - 1].withColumn("g", F.floor(F.col("at") / span))
            held = began.select(F.col("run_id").alias("s_id"), F.col("at").alias("s_at"), "start")
            starts = staged(below.join(held, (F.col("run_id") == F.col("s_id")) & (F.col("at") == F.col("s_at")), "left").select("run_id", "at", "effects", "start", "g"))
    held = staged(began).select(F.col("run_id").alias("s_id"), F.col("at").alias("s_at"), "start")
    return parts.join(held, (F.col("run_id") == F.col("s_id")) & (F.col("at") == F.col("s_at"))).select("run_id", "at", "text", "start")


def parse_parts(parts: DataFrame, spacing: int = PART) -> DataFrame:
    """run_id and the parsed parts of each run, as parse_runs gives them; parts: run_id, at, text.

    at: a part's place in its run, in characters or bytes; two parts are about `spacing`
    apart, so that FAN of them span FAN * spacing. A null text is empty.
    """
    shown = _begun(parts, spacing).mapInArrow(_read, "run_id long, at long, shown binary")
    rows = shown.groupBy("run_id").agg(F.array_sort(F.collect_list(F.when(F.col("shown").isNotNull(), F.struct("at", "shown")))).alias("shown"))
    return rows.mapInArrow(_together, "run_id long, " + PARSED_DDL)


def _placed(batches):
    """The frames of each part, one a row, with their number in its direct or late family."""
    for batch in batches:
        for run, at, text, start in zip(*(batch.column(n).to_pylist() for n in ("run_id", "at", "text", "start")), strict=True):
            frames = read_part(text or "", pickle.loads(start)).frames
            rows = [{"run_id": run, "at": at, "late": late, "nth": nth, **f} for late in (False, True) for nth, f in enumerate(frames["late" if late else "direct"])]
            if rows:
                yield pa.RecordBatch.from_pylist(rows, _PLACED)


_PLACED = pa.schema([("run_id", pa.int64()), ("at", pa.int64()), ("late", pa.bool_()), ("nth", pa.int64()), *FRAME])
_PLACED_DDL = "run_id long, at long, late boolean, nth long, path string, line int, function string, language string, path_hint string, vendored boolean, block int"


def frames_of_parts(parts: DataFrame, spacing: int = PART) -> DataFrame:
    """unique_frames(parse_parts(parts, spacing)), without a row or a task for all frames of a run.

    Only the numbers of frames in the parts of a run are put in order.
    """
    shown = staged(_begun(parts, spacing).mapInArrow(_placed, _PLACED_DDL))
    order = Window.partitionBy("c_id").orderBy("c_late", "c_at").rowsBetween(Window.unboundedPreceding, -1)
    counts = shown.groupBy(F.col("run_id").alias("c_id"), F.col("late").alias("c_late"), F.col("at").alias("c_at")).agg(F.count("*").alias("n"))
    before = counts.select("c_id", "c_late", "c_at", F.coalesce(F.sum("n").over(order), F.lit(0)).alias("before"))
    fields = F.struct("late", "at", "nth", *[f.name for f in FRAME])
    first = shown.groupBy("run_id", folded(F.col("path")).alias("place"), F.col("line").alias("at_line")).agg(F.min(fields).alias("f")).select("run_id", "f.*")
    met = first.join(before, (F.col("run_id") == F.col("c_id")) & (F.col("late") == F.col("c_late")) & (F.col("at") == F.col("c_at")))
    return met.select("run_id", (F.col("before") + F.col("nth")).cast("int").alias("pos"), *[f.name for f in FRAME])


def cut_text(text: str, size: int) -> Iterator[tuple[int, str]]:
    """(place, text) of parts of at least `size` characters, cut after line breaks; a longer line stays whole."""
    at = 0
    while at < len(text):
        end = text.find("\n", min(at + size, len(text)) - 1)
        end = len(text) if end < 0 else end + 1
        yield at, text[at:end]
        at = end


def _cut(batches, size: int):
    for batch in batches:
        for run, text in zip(batch.column("run_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
            for at, part in cut_text(text or "", size):
                yield pa.RecordBatch.from_arrays([pa.array([run], pa.int64()), pa.array([at], pa.int64()), pa.array([part], pa.string())], names=["run_id", "at", "text"])


def parse_long_runs(runs: DataFrame, size: int = PART) -> DataFrame:
    """parse_runs for runs whose output is too long for one task to read, but not for a row."""
    text = F.concat(F.coalesce("stdout", F.lit("")), F.lit("\n"), F.coalesce("stderr", F.lit("")))
    parts = runs.select(F.col("run_id").cast("long").alias("run_id"), text.alias("text")).mapInArrow(lambda batches: _cut(batches, size), "run_id long, at long, text string")
    return parse_parts(staged(parts), size)


def parse_any(runs: DataFrame, size: int = PART) -> DataFrame:
    """parse_runs for runs of up to `size` characters, parse_long_runs for longer ones, if there are any."""
    length = F.coalesce(F.length("stdout"), F.lit(0)) + F.coalesce(F.length("stderr"), F.lit(0))
    if runs.where(length > size).isEmpty():
        return parse_runs(runs)
    return parse_runs(runs.where(length <= size)).unionByName(parse_long_runs(runs.where(length > size), size))
