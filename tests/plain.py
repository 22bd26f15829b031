"""Plain Python versions of the interval operations, to compare with."""


def ratio(a, b):
    shared = min(a["end"], b["end"]) - max(a["start"], b["start"])
    shorter = min(a["end"] - a["start"], b["end"] - b["start"])
    return shared / shorter if shared > 0 and shorter > 0 else 0.0


def strict(a, b):
    return a["start"] < b["end"] and a["end"] > b["start"]


def greedy(spans, clash):
    kept = []
    for s in spans:
        if not any(clash(s, k) for k in kept):
            kept.append(s)
    return kept


def groups(spans, joins):
    out = []
    for s in spans:
        for g in out:
            if joins(g[0], s):
                g.append(s)
                break
        else:
            out.append([s])
    return out


def suppress(spans, threshold=0.8):
    return greedy(sorted(spans, key=lambda s: -s["confidence"]), lambda a, b: ratio(a, b) >= threshold)


def weighted(spans, weights):
    out = []
    for g in groups(spans, lambda a, b: ratio(a, b) > 0.3):
        w = [weights.get(s["method"], 0.5) for s in g]
        if len(g) == 1:
            out.append(g[0])
        else:
            mean = sum(s["confidence"] * x for s, x in zip(g, w, strict=True)) / sum(w)
            out.append({**g[w.index(max(w))], "confidence": mean, "method": "weighted_combination"})
    return out


def typed(spans, weights):
    kept = []
    for s in sorted(spans, key=lambda s: (s["start"], s["end"])):
        old = next((k for k in kept if strict(s, k)), None)
        if old is None:
            kept.append(s)
        elif (weights.get(s["method"], 0.5), s["confidence"]) > (weights.get(old["method"], 0.5), old["confidence"]):
            kept.remove(old)
            kept.append(s)
    return kept
