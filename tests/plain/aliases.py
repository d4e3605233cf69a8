"""Alias resolution in order, over all records at once: what the form by components is held against."""

import re


def canonical(name):
    bare = re.sub(r"\s*\([A-Za-z0-9][A-Za-z0-9_-]{1,20}\)\s*$", "", re.sub(r"\s+", " ", name or "").strip())
    return re.sub(r"[\s_-]+", " ", bare).strip().lower()


def fold(records):
    """records: (name, aliases) in order -> the key of each; None for a name that is none."""
    points, out = {}, []
    for name, aliases in records:
        names = [x for x in dict.fromkeys(canonical(x) for x in (name, *aliases)) if x]
        if not canonical(name):
            out.append(None)
            continue
        key = next((points[x] for x in names if x in points), canonical(name))
        for x in names:
            points[x] = key
        out.append(key)
    return out
