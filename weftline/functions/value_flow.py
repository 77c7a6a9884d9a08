"""Interprocedural value flow: a context-sensitive fixpoint over a supplied three-address program.

The heap is mutated under budgets, so this is not relational; each program component is solved in one grouped
task. A value is a set of atoms, of origins, and of reasons why it is not known; joins are unions with absorbing
budgets. A context is a function with its last two call sites and its arguments.
"""

from __future__ import annotations

import json
from collections import deque
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame

CONTEXTS, ITERATIONS, VALUES, HEAP = 512, 10_000, 32, 10_000


@dataclass(frozen=True)
class Value:
    atoms: frozenset = frozenset()
    origins: frozenset = frozenset()
    reasons: frozenset = frozenset()

    @property
    def bottom(self) -> bool:
        return not self.atoms and not self.reasons

    @property
    def single_string(self) -> str | None:
        one = next(iter(self.atoms)) if len(self.atoms) == 1 and not self.reasons else None
        return one[1] if one and one[0] == "string" else None

    def join(self, other: Value, limit: int = VALUES) -> Value:
        atoms, origins, reasons = self.atoms | other.atoms, self.origins | other.origins, self.reasons | other.reasons
        if "origin-budget" in reasons or len(origins) > 4 * limit:
            origins, reasons = frozenset(), reasons | {"origin-budget"}
        if "value-budget" in reasons or len(atoms) > limit:
            atoms, reasons = frozenset(), reasons | {"value-budget"}
        return Value(atoms, origins, reasons)


BOTTOM = Value()


def unknown(reason: str) -> Value:
    return Value(reasons=frozenset([reason]))


@dataclass
class Context:
    function: dict
    key: tuple
    arguments: list[Value]
    result: Value = BOTTOM
    registers: dict[int, Value] = field(default_factory=dict)
    callers: set = field(default_factory=set)


@dataclass
class Solver:
    """``program``: {"functions": [{"id", "blocks": [{"id", "instructions": [[register, op, ...]], "end": [...]}]}]}.

    Operations: const kind value; param i; copy r; local name [r]; read r; write r r; closure f [r..]; call r [r..]
    [await]; symbol name; concat [r..]; unknown reason [r..] writes. Ends: return [r]; jump b; branch r b b; stop reason.
    """

    program: dict
    contexts_limit: int = CONTEXTS
    iterations_limit: int = ITERATIONS
    values_limit: int = VALUES
    heap_limit: int = HEAP

    def __post_init__(self) -> None:
        self.functions = {f["id"]: f for f in self.program["functions"]}
        self.contexts: dict[tuple, Context] = {}
        self.heap: dict[tuple, Value] = {}
        self.readers: dict[tuple, set] = {}
        self.unique: dict[tuple, bool] = {}
        self.escaped: set = set()
        self.edges: set = set()
        self.limitations: set[str] = set()
        self.work: deque = deque()
        self.queued: set = set()

    def push(self, key: tuple) -> None:
        if key not in self.queued:
            self.queued.add(key)
            self.work.append(key)

    def context(self, fid: str, sites: tuple, args: list[Value], caller: tuple | None) -> Context | None:
        key = (fid, sites[-2:], tuple(args))
        c = self.contexts.get(key)
        if c is None:
            if len(self.contexts) >= self.contexts_limit:
                self.limitations.add("context-budget")
                return None
            c = self.contexts[key] = Context(self.functions[fid], key, args)
            self.push(key)
        if caller is not None:
            c.callers.add(caller)
        return c

    def solve(self, roots: list[str]) -> Solver:
        for r in roots:
            f = self.functions.get(r)
            if f:
                self.context(r, (), [unknown("external-argument")] * f.get("parameters", 0), None)
        steps = 0
        while self.work:
            steps += 1
            if steps > self.iterations_limit:
                self.limitations.add("iteration-budget")
                for c in self.contexts.values():
                    c.result = c.result.join(unknown("iteration-budget"), self.values_limit)
                break
            key = self.work.popleft()
            self.queued.discard(key)
            self.evaluate(self.contexts[key])
        return self

    def evaluate(self, c: Context) -> None:
        blocks = {b["id"]: b for b in c.function["blocks"]}
        pending, seen_in = deque([c.function.get("entry", 0)]), {}
        result, visits = c.result, 0
        while pending:
            visits += 1
            if visits > 64 + 8 * len(blocks):
                break
            b = blocks[pending.popleft()]
            before = tuple(sorted((k, v) for k, v in ((i, hash(x)) for i, x in c.registers.items())))
            if seen_in.get(b["id"]) == before:
                continue
            seen_in[b["id"]] = before
            alive = all(self.step(c, i) for i in b["instructions"])
            if not alive:
                continue
            end = b["end"]
            if end[0] == "return":
                result = result.join(c.registers.get(end[1], BOTTOM) if len(end) > 1 and end[1] is not None else Value(frozenset([("unit", None)])), self.values_limit)
            elif end[0] == "jump":
                pending.append(end[1])
            elif end[0] == "branch":
                cond = c.registers.get(end[1], BOTTOM)
                known = {a[1] for a in cond.atoms if a[0] == "boolean"} if not cond.reasons and cond.atoms else {True, False}
                pending.extend([end[2]] * (True in known) + [end[3]] * (False in known))
            else:
                result = result.join(unknown(end[1]), self.values_limit)
        if result != c.result:
            c.result = result
            for k in c.callers:
                self.push(k)

    def store(self, cell: tuple, value: Value, strong: bool) -> None:
        if cell not in self.heap and len(self.heap) >= self.heap_limit:
            self.limitations.add("heap-budget")
            return
        old = self.heap.get(cell, BOTTOM)
        new = value if strong else old.join(value, self.values_limit)
        if new != old:
            self.heap[cell] = new
            for k in self.readers.get(cell, ()):
                self.push(k)

    def invalidate(self, values: list[Value], reason: str) -> None:
        """Mutable memory that the values reach is written by someone unknown, and escapes."""
        todo = [a for v in values for a in v.atoms]
        while todo:
            a = todo.pop()
            if a[0] == "address" and a not in self.escaped:
                self.escaped.add(a)
                inner = self.heap.get(a, BOTTOM)
                todo += list(inner.atoms)
                self.store(a, inner.join(unknown(reason), self.values_limit), False)
            elif a[0] == "closure":
                todo += [x for v in a[2] for x in v.atoms]

    def step(self, c: Context, ins: list) -> bool:
        reg, op, *a = ins
        get = lambda r: c.registers.get(r, BOTTOM)
        origin = frozenset([(c.function["id"], reg)])
        uses = [x for x in a if isinstance(x, int)] if op in ("copy", "read", "write") else []
        if any(get(r).bottom for r in uses):
            return False
        if op == "const":
            v = Value(frozenset([(a[0], a[1])]), origin)
        elif op == "param":
            v = c.arguments[a[0]] if a[0] < len(c.arguments) else unknown("argument-mismatch")
        elif op == "copy":
            v = get(a[0])
            self.edges.add((c.function["id"], a[0], c.function["id"], reg, "value"))
        elif op == "local":
            cell = ("address", (c.key[0], c.key[1], reg))
            v = Value(frozenset([cell]), origin)
            if len(a) > 1 and a[1] is not None:
                self.store(cell, get(a[1]), cell not in self.escaped)
        elif op == "read":
            v = BOTTOM
            for cell in get(a[0]).atoms:
                self.readers.setdefault(cell, set()).add(c.key)
                v = v.join(self.heap.get(cell, BOTTOM), self.values_limit)
            if get(a[0]).reasons:
                v = v.join(Value(reasons=get(a[0]).reasons), self.values_limit)
            if v.bottom:
                return False
        elif op == "write":
            cells = get(a[0]).atoms
            strong = len(cells) == 1 and not get(a[0]).reasons and next(iter(cells)) not in self.escaped
            for cell in cells:
                self.store(cell, get(a[1]), strong)
            self.edges.add((c.function["id"], a[1], c.function["id"], a[0], "store"))
            v = Value(frozenset([("unit", None)]))
        elif op == "closure":
            v = Value(frozenset([("closure", a[0], tuple(get(r) for r in a[1]))]), origin)
        elif op == "symbol":
            v = Value(frozenset([("function", a[0])]), origin) if a[0] in self.functions else unknown("external-symbol")
        elif op == "concat":
            parts = [get(r) for r in a[0]]
            if any(p.bottom for p in parts):
                return False
            strings = [p.single_string for p in parts]
            v = Value(frozenset([("string", "".join(strings))]), origin) if all(s is not None for s in strings) else unknown("operator")
        elif op == "call":
            v = self.call(c, reg, get(a[0]), [get(r) for r in a[1]], bool(a[2]) if len(a) > 2 else False)
            if v is None or v.bottom:
                return False
        else:
            inputs = [get(r) for r in (a[1] if len(a) > 1 else [])]
            if len(a) > 2 and a[2]:
                self.invalidate(inputs, a[0])
            v = unknown(a[0])
        old = c.registers.get(reg, BOTTOM)
        c.registers[reg] = old.join(v, self.values_limit)
        return True

    def call(self, c: Context, site: int, callee: Value, args: list[Value], awaits: bool) -> Value | None:
        if callee.bottom or any(x.bottom for x in args):
            return None
        out = BOTTOM
        if callee.reasons:
            self.invalidate(args, "unknown-callee")
            out = unknown("unknown-callee")
        if awaits:
            for cell in list(self.escaped):
                self.store(cell, unknown("await"), False)
        for atom in callee.atoms:
            fid = atom[1] if atom[0] in ("function", "closure") else None
            f = self.functions.get(fid)
            captures = list(atom[2]) if atom[0] == "closure" else []
            if f is None or not f.get("blocks"):
                self.invalidate(args, "missing-body")
                out = out.join(unknown("missing-body"), self.values_limit)
                continue
            if f.get("parameters", 0) != len(args) + len(captures):
                self.invalidate(args, "argument-mismatch")
                out = out.join(unknown("argument-mismatch"), self.values_limit)
                continue
            inner = self.context(fid, (*c.key[1], (c.function["id"], site)), captures + args, c.key)
            if inner is None:
                self.invalidate(args, "context-budget")
                out = out.join(unknown("context-budget"), self.values_limit)
                continue
            self.edges.add((c.function["id"], site, fid, -1, "invoke"))
            self.edges.add((fid, -1, c.function["id"], site, "return-to-call"))
            out = out.join(inner.result, self.values_limit)
        return out

    def results(self) -> list[tuple]:
        """(function, register, value as text, known) joined over contexts; register -1 is the result."""
        joined: dict[tuple[str, int], Value] = {}
        for c in self.contexts.values():
            for r, v in [*c.registers.items(), (-1, c.result)]:
                k = (c.function["id"], r)
                joined[k] = joined.get(k, BOTTOM).join(v, self.values_limit)
        show = lambda v: ",".join(sorted(f"{a[0]}:{a[1]}" for a in v.atoms) + sorted(f"?{r}" for r in v.reasons))
        return [(f, r, show(v), not v.reasons) for (f, r), v in sorted(joined.items())]


def solve_programs(programs: DataFrame, roots_column: str = "roots") -> DataFrame:
    """One task per program row (component, program as JSON, roots): component, function, register, value, known."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for row in pdf.itertuples():
            s = Solver(json.loads(row.program)).solve(list(getattr(row, roots_column)))
            out += [(row.component, *r) for r in s.results()]
        return pd.DataFrame(out, columns=["component", "function", "register", "value", "known"])

    return programs.groupBy("component").applyInPandas(run, "component string, function string, register int, value string, known boolean")


def bridge_constants(values: DataFrame, sites: DataFrame) -> DataFrame:
    """sites (location, component, function, register) whose value is one and the same string in all contexts."""
    from pyspark.sql import functions as F

    v = sites.join(values, ["component", "function", "register"])
    text = F.when(F.col("known") & F.col("value").rlike(r"^string:[^,]*$"), F.substring("value", 8, 1 << 20))
    g = v.groupBy("location").agg(F.count_distinct("value").alias("n"), F.count("*").alias("all"), F.min(text).alias("constant"), F.count(text).alias("known"))
    return g.where("n = 1 and known = `all`").select("location", "constant")
