"""Plain Python versions of the sequential rules, to test the columns against."""


def spans(tags, strict=True):
    """Spans by a left-to-right walk that keeps the open span in a state."""
    out, open_type, start = [], None, None
    for i, tag in enumerate([*tags, "O"]):
        kind, name = (tag[0], tag[2:]) if tag[:2] in ("B-", "I-") else ("O", None)
        if kind == "I" and name == open_type:
            continue
        if open_type is not None:
            out.append((open_type, start, i))
        opens = kind == "B" or (kind == "I" and not strict)
        open_type, start = (name, i) if opens else (None, None)
        # an orphan under the strict rule swallows its successors of the same type, because nothing is open
    return out


def counts(gold, pred):
    g, p = set(spans(gold)), set(spans(pred))
    return len(g & p), len(p), len(g)


def outcome(gold, pred):
    p = spans(pred)
    kinds = {"exact": 0, "boundary": 0, "omission": 0}
    for t, s, e in spans(gold):
        if (t, s, e) in p:
            kinds["exact"] += 1
        elif any(pt == t and ps < e and pe > s for pt, ps, pe in p):
            kinds["boundary"] += 1
        else:
            kinds["omission"] += 1
    return kinds
