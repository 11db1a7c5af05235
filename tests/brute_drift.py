"""A plain Python reading of the change definition, for tests."""

import json
from collections import defaultdict

KIND = {dict: "object", list: "array", str: "string", bool: "boolean", int: "number", float: "number"}


def fields(texts):
    out = defaultdict(set)

    def walk(o, p):
        if isinstance(o, dict):
            for k, v in o.items():
                q = f"{p}.{k}" if p else k
                out[q] |= {KIND[type(v)]} if v is not None else set()
                walk(v, q)
        elif isinstance(o, list):
            for v in o:
                walk(v, p)

    for t in texts:
        try:
            o = json.loads(t)
        except (ValueError, TypeError):
            continue
        if isinstance(o, dict):
            walk(o, "")
    return out


def brute_changes(rows):
    """rows: (run, seq, record). Gives (run, seq, path, kind, former); ambiguous renames in order of names."""
    files = defaultdict(lambda: defaultdict(list))
    for run, seq, record in rows:
        files[run][seq].append(record)
    found = set()
    for run, by in files.items():
        seqs = sorted(by)
        for a, b in zip(seqs, seqs[1:]):
            old, new = fields(by[a]), fields(by[b])
            retyped = {p for p in old if p in new and old[p] and new[p] and old[p] != new[p]}
            changed = (set(old) ^ set(new)) | retyped
            top = {p for p in changed if not any(p.startswith(q + ".") for q in changed if q != p)}
            found |= {(run, b, p, "retyped", "") for p in top & retyped}
            gone, come = sorted(top & set(old) - set(new)), sorted(top & set(new) - set(old))
            for p in list(gone):
                for q in list(come):
                    if p.rpartition(".")[0] == q.rpartition(".")[0] and old[p] == new[q]:
                        found.add((run, b, q, "renamed", p))
                        gone.remove(p)
                        come.remove(q)
                        break
            found |= {(run, b, p, "removed", "") for p in gone} | {(run, b, p, "added", "") for p in come}
    return found
