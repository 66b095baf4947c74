"""Plain restatements of masking and of the ladder of translation, one text at a time."""

import regex

from quire.functions import text as T
from quire.operators import masking

ANY, LOOSE, HELD, LEFT, UNSAFE = (regex.compile(p, regex.V0) for p in (masking.ANY, masking.LOOSE, masking.PLACEHOLDER, masking.LEFT, masking.UNSAFE))
KINDS = [(k, regex.compile(p, regex.S)) for k, p in masking.TOKENS]
ENDS = regex.compile(rf"^{T.WHITE}+|{T.WHITE}+\Z")
STRIPPED = lambda x: ENDS.sub("", x)


def mask(text):
    tokens, pieces, at = [], [], 0
    for m in ANY.finditer(text):
        pieces.append(text[at : m.start()])
        tokens.append(m[0])
        at = m.end()
    held = {f"{next(k for k, p in KINDS if p.fullmatch(t))}{i}": t for i, t in enumerate(tokens, 1)}
    shown = [f'<{n} v="{STRIPPED(UNSAFE.sub("", t))[:12]}"/>' for n, t in held.items()]
    return "".join(x for pair in zip(pieces, shown) for x in pair) + text[at:], held


def unmask(text, held):
    seen = dict.fromkeys(held, 0)

    def original(m):
        if m[1] not in held:
            return m[0]
        seen[m[1]] += 1
        return held[m[1]]

    out = LOOSE.sub(original, text)
    return out, [n for n, k in seen.items() if not k], [n for n, k in seen.items() if k > 1] + LEFT.findall(out)


def cut_in_two(text, allowed, glue):
    """Every place is tried; the one nearest to the middle that is allowed, and leaves something on both sides."""
    places = sorted((abs(2 * k - len(text)), k) for k in range(1, len(text)) if allowed(text, k))
    if not places:
        return None
    left, right = text[: places[0][1]], text[places[0][1] :]
    if glue:
        left, right = regex.sub(T.WHITE + r"+\Z", "", left), regex.sub("^" + T.WHITE + "+", "", right)
    return (left, right) if STRIPPED(left) and STRIPPED(right) else None


def sentence_end(text, k):
    gap = regex.search(r"(?<=[.!?…])\s+\Z", text[:k])
    return gap is not None and not text[k].isspace() and not any(m.start() < k < m.end() for m in ANY.finditer(text))


def row_end(text, k):
    return regex.search(r"(?i)</tr\s*>\Z", text[:k]) is not None and regex.search(r"(?i)</tr\s*>", text[k:]) is not None


def prose(text):
    return not any(regex.match(r"\s*(?:[|>*-]|\d+\.|```)", x) for x in text.split("\n"))


def attempt(src, translator, request):
    """(text or None, counts) of a unit; translator takes one request."""
    counts = {"retried": 0, "repaired": 0, "split": 0, "sanitized": 0}

    def had(text, context):
        masked, held = mask(text)
        asked = {**request, "masked": masked, "context": context, "broken": None, "wrong": None}
        for turn in (0, 1):
            reply = translator(asked)
            outside = HELD.sub("", reply)
            for needle, stands in masking.INVENTED:
                counts["sanitized"] += outside.count(needle)
                reply = reply.replace(needle, stands)
            out, missing, twice = unmask(reply, held)
            if STRIPPED(out) and not missing and not twice:
                return out, turn
            asked = {**asked, "broken": reply, "wrong": missing + twice}
        return None, 2

    def table(text, room):
        out, _ = had(text, None)
        halves = cut_in_two(text, row_end, False) if out is None and room else None
        if halves is None:
            return out
        left = table(halves[0], room - 1)
        right = table(halves[1], room - 1) if left is not None else None
        return None if right is None else left + right

    out, turns = had(src, request["context"])
    counts["retried"], counts["repaired"] = int(turns > 0), int(turns == 1)
    if out is not None:
        return out, counts
    if src.lstrip().lower().startswith("<table"):
        halves = cut_in_two(src, row_end, False)
        parts = halves and [table(halves[0], 1)]
        if parts and parts[0] is not None:
            parts.append(table(halves[1], 1))
        glue = ""
    else:
        halves = cut_in_two(src, sentence_end, True) if prose(src) else None
        parts = halves and [had(halves[0], request["context"])[0]]
        if parts and parts[0] is not None:
            parts.append(had(halves[1], halves[0][-200:])[0])
        glue = " "
    if not parts or None in parts:
        return None, counts
    return glue.join(parts), {**counts, "split": 1}
