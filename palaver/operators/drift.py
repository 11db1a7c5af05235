"""Schemas that drift between files: profiles, changes between neighbours, one steady table.

Files of a run follow each other. Each file is profiled by field path (types, null counts, a MinHash
sketch of its values), each profile is compared with that of the file before, names that go and come
under one parent are paired by a maximum-weight bipartite matching of names and value sketches, and
the pairs give every path one steady name.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from palaver.session import cut

TYPES = ("object", "array", "string", "number", "boolean")
SKETCH = 16
_BIT = {dict: 1, list: 2, str: 4, int: 8, float: 8, bool: 16}
#: The bits of JSON types; further bits tell numbers with a fraction, integers beyond 53 and 64 bits.
_KINDS, _FRACTION, _WIDE, _HUGE = 31, 32, 64, 128
_SALTS = np.array([xxhash.xxh64_intdigest(b"%d" % i) for i in range(SKETCH)], dtype=np.uint64)
_FLUSH = 20_000


def below(path: str, name: str) -> str:
    """The path of a field; a dot within a name is written %2E, so that it cannot pass for a step."""
    if "." in name or "%2E" in name:
        name = name.replace("%", "%25").replace(".", "%2E")
    return f"{path}.{name}" if path else name


def shown(path: Column) -> Column:
    """A path with the dots of its names as they stand in the records."""
    return F.when(path.contains("%2E"), F.replace(F.replace(path, F.lit("%2E"), F.lit(".")), F.lit("%25"), F.lit("%"))).otherwise(path)


def _bits(value: object) -> int:
    out = _BIT[type(value)]
    if type(value) is float:
        out |= _FRACTION
    elif type(value) is int and abs(value) > 1 << 53:
        out |= _WIDE | (_HUGE if not -(1 << 63) <= value < 1 << 63 else 0)
    return out


def _walk(node: object, path: str, seen: dict, depth: int = 0) -> None:
    if isinstance(node, dict):
        for k, v in node.items():
            p = below(path, k)
            seen.setdefault(p, []).append(v)
            if isinstance(v, (dict, list)):
                _walk(v, p, seen, depth + 1)
    elif isinstance(node, list):
        for v in node:
            if isinstance(v, (dict, list)):
                _walk(v, path, seen, depth + 1)


def parsed(text: str | None) -> dict | None:
    """The JSON object in ``text``; None if it does not parse, is no object or nests too deeply."""
    try:
        out = json.loads(text) if text else None
    except (ValueError, RecursionError):
        return None
    return out if isinstance(out, dict) else None


def profile(df: DataFrame, run: str, seq: str, record: str) -> DataFrame:
    """One row for each (run, seq, path): ``types`` bit set, counts and value sketch.

    A name with a dot is escaped in its path, see :func:`below`.

    Records are parsed where they lie. Each task first merges what it saw of a (file, path), so the
    shuffle carries profiles and no records, however many rows one file has. A path is there if a
    record that parses holds it, null or not. Rows that do not parse are counted under path ''.
    """
    sk = [f"s{i}" for i in range(SKETCH)]
    schema = f"run string, seq int, path string, types int, n_rows long, n_null long, {', '.join(f'{c} long' for c in sk)}"
    arrow = pa.schema([("run", pa.string()), ("seq", pa.int32()), ("path", pa.string()), ("types", pa.int32()), ("n_rows", pa.int64()), ("n_null", pa.int64()), *[(c, pa.int64()) for c in sk]])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, list] = {}

        def flush() -> pa.RecordBatch:
            rows = [(r, q, p, *v[:3], *[int(x) for x in v[3].view(np.int64)]) for (r, q, p), v in held.items()]
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows), arrow)], schema=arrow)

        for b in batches:
            for r, q, text in zip(*(b.column(i).to_pylist() for i in range(3))):
                doc = parsed(text)
                seen: dict[str, list] = {}
                if doc is None:
                    seen[""] = []
                else:
                    try:
                        _walk(doc, "", seen)
                    except RecursionError:
                        seen = {"": []}
                for p, values in seen.items():
                    v = held.setdefault((r, q, p), [0, 0, 0, np.full(SKETCH, np.iinfo(np.int64).max, dtype=np.uint64)])
                    v[1] += 1
                    for x in values:
                        if x is None:
                            v[2] += 1
                            continue
                        v[0] |= _bits(x)
                        mark = x if isinstance(x, str) else json.dumps(x, sort_keys=True) if not isinstance(x, dict) else ",".join(sorted(x))
                        h = np.uint64(xxhash.xxh64_intdigest(mark.encode("utf-8", "surrogatepass")))
                        np.minimum(v[3], (_SALTS ^ h) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(1), out=v[3])
            if len(held) > _FLUSH:
                yield flush()
        if held:
            yield flush()

    raw = df.select(F.col(run).alias("run"), F.col(seq).cast("int").alias("seq"), F.col(record).alias("record")).mapInArrow(scan, schema)
    return raw.groupBy("run", "seq", "path").agg(
        F.bit_or("types").alias("types"), F.sum("n_rows").alias("n_rows"), F.sum("n_null").alias("n_null"),
        F.array(*[F.min(c) for c in sk]).alias("sketch"),
    )


def _words(name: str) -> list[str]:
    return re.findall(r"[a-z]+|[0-9]+", re.sub(r"([a-z0-9])([A-Z])", r"\1 \2", name).lower())


def likeness(a: str, b: str, sa: list[int], sb: list[int]) -> float:
    """Between 0 and 1: shared words and trigrams of two names, and the overlap of two sketches."""
    wa, wb = set(_words(a)), set(_words(b))
    ja, jb = "".join(_words(a)), "".join(_words(b))
    ta, tb = ({x[i : i + 3] for i in range(max(1, len(x) - 2))} for x in (ja, jb))
    names = max(len(wa & wb) / max(1, min(len(wa), len(wb))), len(ta & tb) / max(1, len(ta | tb)))
    values = float(np.mean(np.array(sa) == np.array(sb))) if len(sa) else 0.0
    return 0.6 * names + 0.4 * values


def best_matching(weight: np.ndarray) -> list[tuple[int, int]]:
    """A maximum-weight matching that pairs as many rows and columns as there can be (Hungarian)."""
    n, m = weight.shape
    if n > m:
        return [(i, j) for j, i in best_matching(weight.T)]
    cost = weight.max(initial=0.0) - weight
    u, v, match = np.zeros(n + 1), np.zeros(m + 1), np.zeros(m + 1, dtype=int)
    for i in range(1, n + 1):
        match[0], j0 = i, 0
        least, way, used = np.full(m + 1, np.inf), np.zeros(m + 1, dtype=int), np.zeros(m + 1, dtype=bool)
        while match[j0]:
            used[j0] = True
            i0 = match[j0]
            now = cost[i0 - 1] - u[i0] - v[1:]
            better = ~used[1:] & (now < least[1:])
            least[1:][better], way[1:][better] = now[better], j0
            free = np.where(used[1:], np.inf, least[1:])
            j1 = int(np.argmin(free)) + 1
            d = free[j1 - 1]
            u[match[used]] += d
            v[used] -= d
            least[1:][~used[1:]] -= d
            j0 = j1
        while j0:
            j1 = way[j0]
            match[j0], j0 = match[j1], j1
    return sorted((int(match[j]) - 1, j - 1) for j in range(1, m + 1) if match[j])


def _pairs(key: tuple, rows: list[dict]) -> Iterator[tuple]:
    gone, come = [r for r in rows if r["kind"] == "removed"], [r for r in rows if r["kind"] == "added"]
    out = {(r["path"], r["kind"]): None for r in rows}
    if gone and come:
        score = np.zeros((len(gone), len(come)))
        for i, a in enumerate(gone):
            for j, b in enumerate(come):
                if a["types"] == b["types"]:
                    score[i, j] = 1.0 + likeness(a["path"].rpartition(".")[2], b["path"].rpartition(".")[2], a["sketch"], b["sketch"])
        for i, j in best_matching(score):
            if score[i, j] >= 1.0:
                out.pop((gone[i]["path"], "removed"))
                out[(come[j]["path"], "added")] = (gone[i]["path"], float(score[i, j] - 1.0))
    for (path, kind), pair in out.items():
        yield (key[0], key[1], path, "renamed" if pair else kind, pair[0] if pair else "", pair[1] if pair else None)


def changes(prof: DataFrame, files: DataFrame) -> DataFrame:
    """Every change of a file against the one before: run, seq, path, kind, former, likeness.

    ``prof`` is from :func:`profile`; ``files`` has the distinct (run, seq) of all files, those in
    which nothing parses included. A name that goes and one of the same types that comes under the
    same parent are a rename; where several go and come, the matching with the greatest likeness
    decides. Below a changed field nothing is reported. An empty input gives no changes.
    """
    from palaver.operators.runs import sorted_groups

    nxt = files.select("run", "seq").distinct().withColumn("next", F.lead("seq").over(W.partitionBy("run").orderBy("seq")))
    first = F.min("seq").over(W.partitionBy("run"))
    at = nxt.withColumn("is_first", F.col("seq") == first)
    p = prof.where(F.col("path") != "").withColumn("types", F.col("types").bitwiseAND(_KINDS)).join(at, ["run", "seq"])
    cols = ["path", "types", "sketch"]
    # A file's profile meets that of the next file by the key (run, seq of the later file, path).
    both = p.where(~F.col("is_first")).select("run", "seq", *cols, F.lit(True).alias("new")).unionByName(
        p.where(F.col("next").isNotNull()).select("run", F.col("next").alias("seq"), *cols, F.lit(False).alias("new"))
    )
    met = both.groupBy("run", "seq", "path").agg(
        F.max(F.when(F.col("new"), F.col("types"))).alias("t1"), F.max(F.when(~F.col("new"), F.col("types"))).alias("t0"),
        F.max(F.when(F.col("new"), F.col("sketch"))).alias("s1"), F.max(F.when(~F.col("new"), F.col("sketch"))).alias("s0"),
    )
    kind = (
        F.when(F.col("t0").isNull(), "added").when(F.col("t1").isNull(), "removed")
        .when((F.col("t0") != F.col("t1")) & (F.col("t0") != 0) & (F.col("t1") != 0), "retyped")
    )
    changed = met.withColumn("kind", kind).where("kind is not null").select(
        "run", "seq", "path", "kind", F.coalesce("t1", "t0").alias("types"), F.coalesce("s1", "s0").alias("sketch")
    )
    parts = F.split("path", r"\.")
    above = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, 1, i), "."))
    deep = changed.where(F.size(parts) > 1).select("run", "seq", "path", F.explode(above).alias("up"))
    under = deep.join(changed.select("run", "seq", F.col("path").alias("up")), ["run", "seq", "up"], "left_semi").select("run", "seq", "path").distinct()
    top = changed.join(under, ["run", "seq", "path"], "left_anti").withColumn("parent", F.regexp_replace("path", r"\.?[^.]*$", ""))
    moved = top.where("kind != 'retyped'")
    # A group is what changed under one parent between two files: as wide as one object at most.
    paired = sorted_groups(moved, ["run", "seq", "parent"], ["path"], _pairs, "run string, seq int, path string, kind string, former string, likeness double")
    same = top.where("kind = 'retyped'").select("run", "seq", "path", "kind", F.lit("").alias("former"), F.lit(None).cast("double").alias("likeness"))
    return paired.unionByName(same)


def steady_names(prof: DataFrame, changed: DataFrame, most: int = 200_000) -> dict[str, str]:
    """Every field path mapped to one steady path.

    Every distinct (former, new) name pair of all runs joins its names, the likest pairs first; of
    joined names the one in most files stands for all. Names that one file holds side by side are
    two fields and never joined, directly or through others, as one of their values would be lost.
    The pairs are schema names, not data: beyond ``most`` of them this stops with an error. Parents
    are mapped before children.
    """
    pairs = cut(changed.where("kind = 'renamed'").groupBy("former", "path").agg(F.avg("likeness").alias("l")))
    names = prof.where("path != ''").groupBy("path").agg(F.count("*").alias("n"), F.max("types").alias("types"))
    paired = pairs.select(F.explode(F.array("former", "path")).alias("path")).distinct()
    side = prof.join(paired, "path").select("run", "seq", "path", F.regexp_replace("path", r"\.?[^.]*$", "").alias("parent"))
    beside = side.join(side.withColumnRenamed("path", "other"), ["run", "seq", "parent"]).where("path < other").select("path", "other").distinct()
    got, known, met = pairs.limit(most + 1).collect(), names.limit(most + 1).collect(), beside.limit(most + 1).collect()
    if max(len(got), len(known), len(met)) > most:
        raise ValueError(f"more than {most} field names: not a table with steady columns")
    got.sort(key=lambda r: (-r["l"], r["former"], r["path"]))
    together: dict[str, set[str]] = {}
    for a, b in met:
        together.setdefault(a, set()).add(b)
        together.setdefault(b, set()).add(a)
    weight = {r["path"]: r["n"] for r in known}
    steady: dict[str, str] = {}
    for depth in range(1, 1 + max((p.count(".") + 1 for p in weight), default=0)):
        level = [p for p in weight if p.count(".") + 1 == depth]
        up = lambda p: (steady[p.rpartition(".")[0]] + "." if depth > 1 else "") + p.rpartition(".")[2]
        root: dict[str, str] = {}

        def find(x: str) -> str:
            while root.setdefault(x, x) != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        count: dict[str, int] = {}
        held: dict[str, set[str]] = {}
        for p in level:
            count[up(p)] = count.get(up(p), 0) + weight[p]
            held.setdefault(up(p), set()).add(p)
        for r in got:
            if r["path"].count(".") + 1 == depth and r["path"] in weight and r["former"] in weight:
                a, b = find(up(r["former"])), find(up(r["path"]))
                if a != b and not any(together.get(p, set()) & held[b] for p in held[a]):
                    keep, lose = sorted((a, b), key=lambda x: (-count.get(x, 0), x))
                    root[lose] = keep
                    held[keep] |= held.pop(lose)
        for p in level:
            steady[p] = find(up(p))
    return steady


def _sql_type(kinds: int) -> str:
    """The column type that holds every value of a field exactly; string for several types."""
    if kinds & _KINDS == 16:
        return "boolean"
    if kinds & _KINDS == 8 and not kinds & _HUGE:
        return "bigint" if not kinds & _FRACTION else "string" if kinds & _WIDE else "double"
    return "string"


def unify(df: DataFrame, record: str, keys: list[str], names: dict[str, str], prof: DataFrame, spare: str = "other_values") -> DataFrame:
    """One row for each record that parses, with a column for each steady top-level field.

    Integers come out as bigint, other numbers as double, booleans as boolean, everything else as
    string; objects and arrays as JSON text with steady names inside. A field that has several types
    in the files, or numbers that neither type holds exactly, becomes the string of its JSON text.
    Where a record holds several spellings of one field, the first that is not null counts; the
    values of the others that differ are in ``spare`` as JSON by their original path, so none is
    lost. Columns that clash with ``keys`` get the suffix ``_value``.
    """
    kinds: dict[str, int] = {}
    for r in prof.where("path != '' and instr(path, '.') = 0").groupBy("path").agg(F.bit_or("types").alias("t")).collect():
        kinds[names[r["path"]]] = kinds.get(names[r["path"]], 0) | r["t"]
    cols = sorted(kinds)
    sql = {c: _sql_type(kinds[c]) for c in cols}
    taken = {*keys, spare}
    outs = [f"{c}_value" if c in taken else c for c in cols]
    tick = lambda c: "`" + c.replace("`", "``") + "`"
    schema = ", ".join([f"{tick(f.name)} {f.dataType.simpleString()}" for f in df.select(*keys).schema] + [f"{tick(o)} {sql[c]}" for o, c in zip(outs, cols)] + [f"{tick(spare)} string"])

    def renamed(node: object, path: str, other: dict[str, list]) -> object:
        if isinstance(node, list):
            return [renamed(v, path, other) for v in node]
        if not isinstance(node, dict):
            return node
        out: dict[str, object] = {}
        for k, v in node.items():
            p = below(path, k)
            name, v = names.get(p, p).rpartition(".")[2], renamed(v, p, other)
            if out.get(name) is None:
                out[name] = v
            elif v is not None and v != out[name]:
                other.setdefault(p, []).append(v)
        return out

    def one(value: object, kind: str) -> object:
        if value is None or kind in ("boolean", "bigint"):
            return value
        if kind == "double":
            return float(value)
        return value if isinstance(value, str) else json.dumps(value, ensure_ascii=False, sort_keys=True)

    arrow = [{"double": pa.float64(), "bigint": pa.int64(), "boolean": pa.bool_()}.get(sql[c], pa.string()) for c in cols]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep, docs, others = [], [], []
            for i, text in enumerate(b.column(b.num_columns - 1).to_pylist()):
                doc = parsed(text)
                if doc is not None:
                    other: dict[str, list] = {}
                    keep.append(i)
                    docs.append(renamed(doc, "", other))
                    others.append(json.dumps(other, ensure_ascii=False, sort_keys=True) if other else None)
            made = [pa.array([one(x.get(c), sql[c]) for x in docs], type=t) for c, t in zip(cols, arrow)]
            at = pa.array(keep, type=pa.int64())
            yield pa.RecordBatch.from_arrays([*[b.column(i).take(at) for i in range(len(keys))], *made, pa.array(others, type=pa.string())], names=[*keys, *outs, spare])

    return df.select(*keys, record).mapInArrow(scan, schema)
