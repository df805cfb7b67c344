"""
brute-force check of the Spark operators on small inputs."""

from __future__ import annotations

from itertools import permutations


def parse(text: str) -> list[dict]:
    kept: list[str] = []
    for line in text.lower().split("\n"):
        if line.strip(" ") and line not in kept:
            kept.append(line)
    out = []
    for n, line in enumerate(kept):
        if n > 0:
            head, *rest = line.split(".")
            if not (head.isascii() and head.isdigit()):
                continue
            line = ".".join(rest)
        parts = line.split(",,")
        if len(parts) < 2:
            continue
        pieces = [x.strip(" ") for x in parts[1].split("###")]
        objs = []
        for o in parts[2:]:
            op = o.split("###")
            objs.append(("", o.strip(" ")) if len(op) == 1 else (op[-2].strip(" "), op[-1].strip(" ")))
        out.append({"subj": parts[0].strip(" "), "pred": pieces[-1], "auxi": pieces[:-1], "objs": objs})
    return out


def _common(a: list[str], b: list[str]) -> int:
    return sum(min(a.count(w), b.count(w)) for w in set(a))


def pair_score(g: dict, p: dict, n_cur: int):
    """(prec, rec, ok_subj_pred) for gold g with current object count n_cur."""
    num = den_p = den_g = 0
    for part in ("subj", "pred"):
        gw, pw = g[part].split(), p[part].split()
        c = _common(gw, pw)
        if c == 0:
            return None, None, False
        num, den_p, den_g = num + c, den_p + len(pw), den_g + len(gw)
    for ga, pa in zip(g["auxi"], p["auxi"]):
        gw, pw = ga.split(), pa.split()
        num, den_p, den_g = num + _common(gw, pw), den_p + len(pw), den_g + len(gw)
    n_p = len(p["objs"])
    if n_p == 0 and n_cur != 0:
        return None, None, True
    for k in range(min(n_cur, n_p)):
        gw, pw = " ".join(g["objs"][k]).split(), " ".join(p["objs"][k]).split()
        c = _common(gw, pw)
        if c == 0:
            return None, None, True
        num, den_p, den_g = num + c, den_p + len(pw), den_g + len(gw)
    return num / den_p, num / den_g, True


def greedy(cells: dict, higher: bool = True) -> list:
    """cells: {(i, j): score}; picks best free cell repeatedly (ties: i, j)."""
    order = sorted(cells.items(), key=lambda kv: ((-kv[1] if higher else kv[1]), kv[0][0], kv[0][1]))
    rows, cols, picked = set(), set(), []
    for (i, j), s in order:
        if i not in rows and j not in cols:
            rows.add(i)
            cols.add(j)
            picked.append(((i, j), s))
    return picked


def plain_tokens(t: dict, objs=None) -> list[str]:
    objs = t["objs"] if objs is None else objs
    text = t["subj"] + " " + (" ".join(t["auxi"]) + " " if t["auxi"] else "") + t["pred"] + " " + \
        " ".join(" ".join(o) for o in objs)
    return text.strip(" ").split()


def edit_distance(a: list, b: list) -> int:
    prev = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        cur = [i]
        for j, y in enumerate(b, 1):
            cur.append(min(prev[j] + 1, cur[j - 1] + 1, prev[j - 1] + (x != y)))
        prev = cur
    return prev[-1]


def sentence(gold_text: str, pred_text: str, mode: str = "sequential") -> dict:
    gold, pred = parse(gold_text), parse(pred_text)
    cut = [len(g["objs"]) for g in gold]
    scores = {}
    for gi, g in enumerate(gold):
        for pi, p in enumerate(pred):
            n_cur = cut[gi] if mode == "sequential" else len(g["objs"])
            pr, rc, ok = pair_score(g, p, n_cur)
            if ok and len(p["objs"]) > 0:
                cut[gi] = min(cut[gi], len(p["objs"]))
            if pr is not None:
                scores[(gi, pi)] = (pr, rc)
    prec_num = sum(s for _, s in greedy({k: v[0] for k, v in scores.items()}))
    rec_num = sum(max([v[1] for (gi, _), v in scores.items() if gi == g] or [0.0]) for g in range(len(gold)))
    dcells = {}
    for gi, g in enumerate(gold):
        gt = plain_tokens(g, g["objs"][:cut[gi]] if mode == "sequential" else None)
        for pi, p in enumerate(pred):
            dcells[(gi, pi)] = min(edit_distance(gt, plain_tokens(p, list(o))) for o in permutations(p["objs"]))
    dists = sorted(s for _, s in greedy(dcells, higher=False))
    return {"prec_num": prec_num, "prec_den": len(pred), "rec_num": rec_num, "rec_den": len(gold),
            "prec": prec_num / len(pred) if pred else 1.0, "rec": rec_num / len(gold) if gold else 0.0,
            "dists": dists}
