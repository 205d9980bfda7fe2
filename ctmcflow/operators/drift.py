"""Records whose schema drifts from file to file, read into one table, with every change reported.

Each file's schema is a tree (record -> fields -> members of objects and of the elements of arrays, to any depth)
gathered by Spark from all its records. Trees are compared by a tree edit distance for unordered trees, the
constrained one of Zhang: subtrees are left out, put in and relabelled at every level, matching siblings by a
least-cost assignment; what is left out on one side and put in on the other may then be a move, whole subtrees
first, single fields by another assignment. The script against the canonical tree says which written field is which
canonical one (kept, renamed, or moved from some depth), and is compiled into the projections that read the records of
every file. The script against the preceding file of the source follows all other fields through renames and moves.

Costs: a field left out or put in 1, a rename from 0 (same name) over spellings of the same quantity to
more than 2 (never taken), a change of type 0.1, a move 0.5.
"""

from __future__ import annotations

import re
import sys
from collections import Counter
from collections.abc import Iterator
from difflib import SequenceMatcher
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

# The canonical record.
CANONICAL = {"network_id": "string", "T_K": "number", "nA": "number", "nB": "number", "MFPT_AB": "number", "MFPT_BA": "number", "Var_AB": "number", "Var_BA": "number"}
# Words by which a name says what it holds.
QUANTITIES = [("variance", r"var"), ("passage", r"mfpt|fpt|passage"), ("count", r"^(n|num|size|count|len)(a|b)$"), ("temperature", r"^(t|temp|temperature)(k|kelvin)?$"), ("network", r"^(network|net|ktn)(id|name)?$")]
DIRECTIONS = [("ab", r"(ab|atob|fwd|forward)$"), ("ba", r"(ba|btoa|rev|reverse|bwd|backward)$"), ("a", r"a$"), ("b", r"b$")]

MOVE = 0.5
WRAPPER = {"value", "unit"}  # members of an object that is only the form of a value
ELEMENT = "[]"


class Node(NamedTuple):
    """A field of a schema: its name, type, share of the records, members, the steps from the record to it, and its nodes."""

    name: str
    kind: str
    share: float
    kids: tuple
    steps: tuple
    size: int


@lru_cache(100_000)
def concept(name: str) -> tuple[str, str] | None:
    """What a field name says: (quantity, direction), or None."""
    x = re.sub(r"[^a-z0-9]", "", name.lower())
    q = next((q for q, p in QUANTITIES if re.search(p, x)), None)
    if q is None:
        return None
    if q in ("temperature", "network"):
        return q, ""
    return q, next((d for d, p in DIRECTIONS if re.search(p, x)), "")


@lru_cache(100_000)
def relabel(a: str, b: str) -> float:
    """Cost of writing b as a; above 2 it is dearer than leaving one out and the other in."""
    if a == b:
        return 0.0
    x, y = (re.sub(r"[^a-z0-9]", "", s.lower()) for s in (a, b))
    if x == y:
        return 0.2
    ca, cb = concept(a), concept(b)
    if ca and ca == cb:
        return 0.4
    if ca is None and cb is None and SequenceMatcher(None, x, y).ratio() > 0.85:
        return 0.9
    return 3.0


def assign(cost: np.ndarray) -> list[int]:
    """Column of each row in a least-cost assignment of a square matrix (shortest augmenting paths)."""
    n = len(cost)
    u, v, match = np.zeros(n + 1), np.zeros(n + 1), np.zeros(n + 1, int)
    for i in range(1, n + 1):
        match[0], j0 = i, 0
        least, used, way = np.full(n + 1, np.inf), np.zeros(n + 1, bool), np.zeros(n + 1, int)
        while True:
            used[j0] = True
            free = ~used[1:]
            cur = cost[match[j0] - 1] - u[match[j0]] - v[1:]
            better = free & (cur < least[1:])
            least[1:][better], way[1:][better] = cur[better], j0
            j1 = 1 + int(np.argmin(np.where(free, least[1:], np.inf)))
            d = least[j1]
            u[match[used]] += d
            v[used] -= d
            least[~used] -= d
            j0 = j1
            if match[j0] == 0:
                break
        while j0:
            match[j0], j0 = match[way[j0]], way[j0]
    out = [0] * n
    for j in range(1, n + 1):
        out[match[j] - 1] = j - 1
    return out


def node(name: str, kind: str, share: float, kids: tuple, steps: tuple) -> Node:
    return Node(name, kind, share, kids, steps, 1 + sum(k.size for k in kids))


def below(t: Node) -> Iterator[Node]:
    for c in t.kids:
        yield c
        yield from below(c)


def tree_of(fields: list[tuple[tuple, str, float]], name: str = "record") -> Node:
    """The tree of the fields (steps, type, share) of a file."""
    kids: dict[tuple, set] = {}
    known = {tuple(s): (t, x) for s, t, x in fields}
    for s in known:
        for i in range(len(s)):
            kids.setdefault(s[:i], set()).add(s[: i + 1])

    def made(s: tuple) -> Node:
        kind, share = known.get(s, ("object" if s[-1:] != (ELEMENT,) else "array", 1.0))
        return node(s[-1] if s else name, kind if s else "object", share if s else 1.0, tuple(made(c) for c in sorted(kids.get(s, []))), s)

    return made(())


def _one(a: Node, b: Node) -> float:
    """Cost of turning the node a, without its members, into b."""
    return relabel(a.name, b.name) + 0.1 * (a.kind != b.kind) + 0.05 * (1 - a.share)


class Edit:
    """Least-cost scripts from one tree into another, children unordered."""

    def __init__(self):
        self.trees: dict = {}
        self.forests: dict = {}

    def tree(self, a: Node, b: Node) -> tuple[float, list]:
        """(cost, matched pairs): roots matched, or one of them put in or left out above the other tree."""
        if not a.kids and not b.kids:
            return _one(a, b), [(a, b)]
        key = (a.steps, b.steps)
        if key not in self.trees:
            c, pairs = self.forest(a.kids, b.kids)
            best = (_one(a, b) + c, [(a, b), *pairs])
            # trees of unlike size differ by as many nodes at least
            for x in a.kids:
                if a.size - x.size + abs(x.size - b.size) < best[0]:
                    c, pairs = self.tree(x, b)
                    best = min(best, (a.size - x.size + c, pairs), key=lambda m: m[0])
            for y in b.kids:
                if b.size - y.size + abs(y.size - a.size) < best[0]:
                    c, pairs = self.tree(a, y)
                    best = min(best, (b.size - y.size + c, pairs), key=lambda m: m[0])
            self.trees[key] = best
        return self.trees[key]

    def forest(self, f: tuple, g: tuple) -> tuple[float, list]:
        """(cost, matched pairs) of two sets of siblings: an assignment, or all of one side below one node of the other."""
        key = (tuple(x.steps for x in f), tuple(x.steps for x in g))
        if key not in self.forests:
            of, og = sum(x.size for x in f), sum(y.size for y in g)
            best = self.match(f, g) if f and g else (float(of + og), [])
            if f and g:
                for x in f:
                    if x.kids and of - x.size + 1 + abs(x.size - 1 - og) < best[0]:
                        c, pairs = self.forest(x.kids, g)
                        best = min(best, (of - x.size + 1 + c, pairs), key=lambda m: m[0])
                for y in g:
                    if y.kids and og - y.size + 1 + abs(y.size - 1 - of) < best[0]:
                        c, pairs = self.forest(f, y.kids)
                        best = min(best, (og - y.size + 1 + c, pairs), key=lambda m: m[0])
            self.forests[key] = best
        return self.forests[key]

    def match(self, f: tuple, g: tuple) -> tuple[float, list]:
        sf, sg = [x.size for x in f], [y.size for y in g]
        # two single fields need no more than their names and types
        c = np.array([[_one(x, y) if not x.kids and not y.kids else self.tree(x, y)[0] for y in g] for x in f])
        to = assignment(c, np.array(sf, float), np.array(sg, float))
        cost = float(sum(sf) + sum(sg) + sum(c[i, j] - sf[i] - sg[j] for i, j in to))
        return cost, [p for i, j in to for p in self.tree(f[i], g[j])[1]]


def assignment(c: np.ndarray, out: np.ndarray, new: np.ndarray) -> list[tuple[int, int]]:
    """Pairs (row, column) of least total cost, where leaving row i and column j alone costs out[i] and new[j].

    Only pairs that gain something count; rows and columns that such pairs tie together are solved apart from all others.
    """
    useful = c < out[:, None] + new[None, :]
    m, n = c.shape
    seen, pairs = np.zeros(m, bool), []
    for start in range(m):
        if seen[start] or not useful[start].any():
            continue
        rows, cols = {start}, set()
        todo = [start]
        while todo:
            i = todo.pop()
            for j in np.flatnonzero(useful[i]):
                if j not in cols:
                    cols.add(j)
                    for k in np.flatnonzero(useful[:, j]):
                        if k not in rows:
                            rows.add(k)
                            todo.append(k)
        r, k = sorted(rows), sorted(cols)
        seen[r] = True
        if len(r) == len(k) == 1:
            pairs.append((r[0], k[0]))
            continue
        q = np.zeros((len(r) + len(k),) * 2)
        q[: len(r), : len(k)] = c[np.ix_(r, k)]
        q[: len(r), len(k) :] = out[r][:, None]
        q[len(r) :, : len(k)] = new[k]
        to = assign(q)
        pairs += [(r[i], k[to[i]]) for i in range(len(r)) if to[i] < len(k) and useful[r[i], k[to[i]]]]
    return [(int(i), int(j)) for i, j in pairs]


def distance(a: Node, b: Node) -> tuple[float, list[tuple[Node, Node]]]:
    """Least cost to edit tree a into b and the matched pairs of nodes, without moves."""
    return Edit().tree(a, b)


def script(a: Node, b: Node) -> tuple[float, list[tuple[str, Node | None, Node | None]]]:
    """Cost and operations of a script that turns a into b: (kept, renamed, moved, added or removed, node of a, node of b)."""
    cost, pairs = distance(a, b)
    to = {x.steps: y for x, y in pairs}
    used = {y.steps for _, y in pairs}
    gone = [x for x in below(a) if x.steps not in to]
    new = [y for y in below(b) if y.steps not in used]
    # whole subtrees that are gone on one side and new on the other, the largest gain first
    edit = Edit()
    free = lambda t, taken: all(z.steps not in taken for z in (t, *below(t)))
    big = sorted(((edit.tree(x, y)[0] + MOVE - x.size - y.size, x, y) for x in gone if x.kids for y in new if y.kids), key=lambda m: m[0])
    for gain, x, y in big:
        if gain < 0 and free(x, to) and free(y, used):
            for p, q in edit.tree(x, y)[1]:
                to[p.steps] = q
                used.add(q.steps)
            cost += gain
    # then single fields
    gone, new = [x for x in gone if x.steps not in to], [y for y in new if y.steps not in used]
    if gone and new:
        c = np.array([[MOVE + _one(x, y) for y in new] for x in gone])
        for i, j in assignment(c, np.ones(len(gone)), np.ones(len(new))):
            to[gone[i].steps] = new[j]
            used.add(new[j].steps)
            cost += c[i, j] - 2
    ops: list = []
    for x in below(a):
        y = to.get(x.steps)
        if y is None:
            ops.append(("removed", x, None))
        else:
            above = to.get(x.steps[:-1], b if len(x.steps) == 1 else None)
            moved = above is None or above.steps != y.steps[:-1]
            ops.append(("moved" if moved else "kept" if x.name == y.name else "renamed", x, y))
    return cost, ops + [("added", None, y) for y in below(b) if y.steps not in used]


def canonical() -> Node:
    return node("record", "object", 1.0, tuple(node(k, t, 1.0, (), (k,)) for k, t in CANONICAL.items()), ())


def shown(steps) -> str:
    """A path for people: the name itself at the top, else names joined by dots, dots in names escaped."""
    return steps[0] if len(steps) == 1 else ".".join(s.replace("\\", "\\\\").replace(".", "\\.") for s in steps)


def schema_fields(text: str) -> list[tuple[tuple, str]]:
    """(steps, type) of every field of a schema text as Spark writes it; arrays of objects have their members below ``[]``.

    Wrappers of a value, ``[x]`` and ``{"value": x, "unit": u}``, belong to its type and have no members.
    """
    token = re.compile(r"(OBJECT<|ARRAY<)|`((?:[^`]|``)*)`: |([^\s<>,:`]+): |([A-Z]+)(\([^)]*\))?|(>)|(, )")
    out: list[tuple[tuple, str]] = []
    path: list[str] = []
    stack: list[str] = []
    named = False
    for m in token.finditer(text):
        opened, quoted, name, plain, _, close, _ = m.groups()
        if quoted is not None or name is not None:
            path.append(quoted.replace("``", "`") if quoted is not None else name)
            named = True
            continue
        if close:
            stack.pop()
            path.pop()
            continue
        if not opened and not plain:
            continue
        if not named:  # the record itself, or the elements of an array
            path.append(ELEMENT if stack else "")
        kind = "object" if opened == "OBJECT<" else "array" if opened else {"STRING": "string", "BOOLEAN": "boolean", "VOID": "null"}.get(plain, "number")
        out.append((tuple(path[1:]), kind))
        named = False
        if opened:
            stack.append(opened)
        else:
            path.pop()
    kinds = dict(out)
    inner = {s for s in kinds if len(s) > 1 and s[-1] == ELEMENT and kinds[s] not in ("object", "array")}
    members: dict[tuple, set] = {}
    for s in kinds:
        if s:
            members.setdefault(s[:-1], set()).add(s[-1])
    form = {s for s, names in members.items() if s and kinds[s] == "object" and "value" in names and names <= WRAPPER}
    return [(s, k) for s, k in out if s and s not in inner and not any(s[:i] in form for i in range(1, len(s)))]


def parsed(df: DataFrame) -> DataFrame:
    """Adds v: the record as a variant, null where the line is broken, empty or no object."""
    v = df.withColumn("v", F.try_parse_json("record"))
    return v.withColumn("v", F.when(F.schema_of_variant("v").startswith("OBJECT"), F.col("v")))


def file_fields(df: DataFrame) -> DataFrame:
    """One row per source, file and field: steps (names from the record down), records, type of most non-null values.

    A file without a readable record has one row without steps. Records of one schema are counted before any of
    it is looked at in Python.
    """
    file = ["source", "file_seq", "file_id"]
    rows = df.select(*file, F.schema_of_variant(F.try_parse_json("record")).alias("schema"))
    rows = rows.groupBy(*file, F.when(F.col("schema").startswith("OBJECT"), F.col("schema")).alias("schema")).agg(F.count("*").alias("n"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict[str, list] = {}
        for pdf in batches:
            counts: Counter = Counter()  # of a batch: fields of few files
            for source, seq, fid, text, n in pdf.itertuples(index=False):
                if text is None:
                    counts[source, seq, fid, None, None] += n
                    continue
                got = known.get(text)
                if got is None:
                    if len(known) > 10_000:
                        known.clear()
                    got = known[text] = schema_fields(text)
                for s, k in got:
                    counts[source, seq, fid, s, k] += n
            yield pd.DataFrame([(*key[:3], None if key[3] is None else list(key[3]), key[4], n) for key, n in counts.items()], columns=[*file, "steps", "type", "n"])

    got = rows.mapInPandas(run, "source string, file_seq int, file_id long, steps array<string>, type string, n long")
    counts = got.groupBy(*file, "steps", "type").agg(F.sum("n").alias("n"))
    best = F.max(F.when(F.col("type") != "null", F.struct("n", "type")))["type"]
    return counts.groupBy(*file, "steps").agg(F.sum("n").alias("n"), best.alias("type"))


_SCRIPTS = "source string, file_seq int, file_id long, path string, steps array<string>, field string, operation string, type string, was string, was_type string"


def file_scripts(fields: DataFrame) -> DataFrame:
    """One row per file and field: source, file_seq, file_id, path and steps as written, field (canonical, else as
    written), operation against the canonical record (kept, renamed, moved, other), type. Where a field that is not canonical
    was renamed or moved since the preceding file of the source, was and was_type say how it was there.
    """
    one = F.when(F.col("steps").isNotNull(), F.struct("steps", "type", "n"))
    files = fields.groupBy("source", "file_seq", "file_id").agg(F.collect_list(one).alias("fields"))
    files = files.withColumn("before", F.lag("fields").over(Window.partitionBy("source").orderBy("file_seq", "file_id")))
    # few bytes but work in Python: spread over all tasks whatever the size
    files = files.repartition(int(fields.sparkSession.conf.get("spark.sql.shuffle.partitions")), "file_id")

    def alike(got) -> tuple:
        got = sorted((tuple(f["steps"]), f["type"] or "null", int(f["n"])) for f in got)
        most = max((n for _, _, n in got), default=1)
        return tuple((s, t, round(n / most, 1)) for s, t, n in got)  # files alike share one script

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sys.setrecursionlimit(20_000)
        canon, to_canon, since = canonical(), {}, {}

        def mapped(key: tuple) -> dict:
            if key not in to_canon:
                if len(to_canon) > 5_000:
                    to_canon.clear()
                to_canon[key] = {x.steps: (op, y.name) for op, x, y in script(tree_of(list(key)), canon)[1] if x is not None and y is not None}
            return to_canon[key]

        def others(key: tuple) -> Node:
            """The tree without the fields that are canonical."""
            return tree_of([f for f in key if f[0] not in mapped(key)])

        for pdf in batches:
            out = []
            for source, seq, fid, got, before in pdf.itertuples(index=False):
                key = alike(got)
                was: dict = {}
                if before is not None and len(before):
                    pair = (alike(before), key)
                    if pair not in since:
                        if len(since) > 5_000:
                            since.clear()
                        # fields that keep their path, in any case, are the same by it; members go with what was renamed or moved above them
                        moves = [(x, y) for _, x, y in script(others(pair[0]), others(key))[1] if x and y and shown(x.steps).lower() != shown(y.steps).lower()]
                        since[pair] = {y.steps: (shown(x.steps), x.kind) for x, y in moves if ELEMENT not in (x.name, y.name)}
                    was = since[pair]
                for s, t, _ in key:
                    if s[-1] != ELEMENT:
                        op, name = mapped(key).get(s, ("other", None))
                        out.append((source, seq, fid, shown(s), list(s), name or shown(s), op, t, *was.get(s, (None, None))))
            if out:
                yield pd.DataFrame(out, columns=[c.split()[0] for c in _SCRIPTS.split(", ")])

    return files.mapInPandas(run, _SCRIPTS)


def changes(df: DataFrame, scripts: DataFrame) -> DataFrame:
    """file_id, field, change against the preceding file of the same source.

    change: added, removed, renamed, type_changed. The first file of a source has none. Files without any
    readable record count as files without fields. Fields other than the canonical ones are followed by
    their name in any case, and from one file to the next through the renames and moves of the scripts; nested ones
    have their path as name.
    """
    files = df.select("source", "file_seq", "file_id").distinct()
    w = Window.partitionBy("source").orderBy("file_seq", "file_id")
    files = files.withColumn("at", F.row_number().over(w)).withColumn("next_id", F.lead("file_id").over(w))
    rows = scripts.select("file_id", "path", "field", F.lower("field").alias("f"), F.when(F.col("type") != "null", F.col("type")).alias("type"), "was", F.when(F.col("was_type") != "null", F.col("was_type")).alias("was_type")).join(files, "file_id")
    # a field that goes on under another name in the next file is not removed
    goes_on = scripts.filter("was IS NOT NULL").select(F.col("file_id").alias("next_id"), F.col("was").alias("path"), F.lit(True).alias("goes_on")).distinct()
    rows = rows.join(goes_on, ["next_id", "path"], "left")
    one = Window.partitionBy("source", "f").orderBy("at")
    r = rows.withColumns({"p_at": F.lag("at").over(one), "p_path": F.lag("path").over(one), "n_at": F.lead("at").over(one)})
    r = r.withColumn("here", F.coalesce(F.col("p_at") == F.col("at") - 1, F.lit(False)))
    r = r.withColumn("run", F.sum((~F.col("here")).cast("int")).over(one))
    since = Window.partitionBy("source", "f", "run").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    r = r.withColumn("p_type", F.last("type", ignorenulls=True).over(since))
    kind = F.array(
        F.when((F.col("at") > 1) & ~F.col("here") & F.col("was").isNull(), F.struct(F.col("file_id").alias("file_id"), F.lit("added").alias("change"))),
        F.when(F.when(F.col("here"), F.col("path") != F.col("p_path")).otherwise(F.col("was").isNotNull()), F.struct(F.col("file_id").alias("file_id"), F.lit("renamed").alias("change"))),
        F.when(F.when(F.col("here"), F.col("type") != F.col("p_type")).otherwise(F.col("type") != F.col("was_type")), F.struct(F.col("file_id").alias("file_id"), F.lit("type_changed").alias("change"))),
        F.when(F.col("next_id").isNotNull() & F.col("goes_on").isNull() & ~F.coalesce(F.col("n_at") == F.col("at") + 1, F.lit(False)), F.struct(F.col("next_id").alias("file_id"), F.lit("removed").alias("change"))),
    )
    return r.select("field", F.inline(F.filter(kind, lambda x: x.isNotNull()))).select("file_id", "field", "change")


def _value(c: Column) -> Column:
    """A number out of the text of a JSON value: 1, "1", [1] or {"value": 1, ...}; null where there is none."""
    x = F.when(c.startswith("["), F.get(F.from_json(c, "array<string>"), F.lit(0))).when(c.startswith("{"), F.get_json_object(c, "$.value")).otherwise(c)
    x = F.trim(x)
    return F.when(x.rlike("^[-+]?([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][-+]?[0-9]+)?$"), x.try_cast("double"))


def unified(df: DataFrame, scripts: DataFrame) -> DataFrame:
    """One row per line: file_id, line_no, line (ok, repeat, broken), the canonical fields in one type each.

    Values written as text, one-element lists or {"value": x} become numbers; text that is none, "nan" and
    "inf" become null. A line that repeats an earlier line of its file says so and is kept. ``other`` holds the
    fields that are not canonical. Broken and empty lines and lines that are no object come out with nulls.
    """
    plan = scripts.filter("operation IN ('kept', 'renamed', 'moved')").groupBy("file_id").agg(F.map_from_entries(F.collect_list(F.struct("field", "steps"))).alias("plan"))
    rows = parsed(df.select("file_id", "line_no", "source", "record")).withColumn("ok", F.col("v").isNotNull()).drop("v")
    w = Window.partitionBy("file_id", F.xxhash64("record"), "record").orderBy("line_no")
    rows = rows.withColumn("again", F.row_number().over(w) > 1)
    j = rows.join(plan, "file_id", "left").withColumn("m", F.when(F.col("ok"), F.from_json("record", "map<string,string>")))

    def raw(name: str) -> Column:
        """The text at the path that the file's script names: a member of the record, and from there down."""
        steps = F.col("plan")[name]
        down = lambda v, s: F.when(s == ELEMENT, F.get(F.from_json(v, "array<string>"), F.lit(0))).otherwise(F.element_at(F.from_json(v, "map<string,string>"), s))
        return F.aggregate(F.slice(steps, F.lit(2), F.size(steps)), F.col("m")[F.get(steps, F.lit(0))], down)

    out = {k: (raw(k) if t == "string" else _value(raw(k))) for k, t in CANONICAL.items()}
    out |= {k: out[k].cast("long") for k in ("nA", "nB")}
    used = F.coalesce(F.transform(F.filter(F.map_values("plan"), lambda s: F.size(s) == 1), lambda s: s[0]), F.array().cast("array<string>"))
    return j.select(
        "file_id", "line_no", "source", F.when(~F.col("ok"), "broken").when(F.col("again"), "repeat").otherwise("ok").alias("line"),
        *[c.alias(k) for k, c in out.items()],
        F.to_json(F.map_filter("m", lambda k, _: ~F.array_contains(used, k))).alias("other"),
    )
