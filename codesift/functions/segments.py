"""Patterns that would read a text many times, in forms that read it once.

A pattern of the shape HEAD ``[^x]*`` TAIL is tried at every HEAD, and each time the gap is read up to the
next x. A gap never crosses an x, so the text falls into segments, and in each of them only the first HEAD
needs to be tried:

- TAIL holds no x: a HEAD that finds no TAIL in the rest of its segment leaves none for the later ones.
- TAIL begins with an x: all HEADs of a segment run to the same x, and what follows it decides for all.

The forms skip to the first HEAD without looking back, and begin again behind an x or behind the last
match. Matches begin at the same places as those of the pattern. Group 1 is the text skipped, group 2 begins
where the match does.

That holds if a HEAD has one end for each start, and ends in the order of their starts; so it is a row of
characters in which runs of blanks may stand. All other patterns are left as they are.
"""

from __future__ import annotations

import re

from codesift.functions import dialect
from codesift.functions.dialect import EVERYTHING, OTHER

BLANKS = frozenset("\t\n\f\r ")
Token = dialect._Token
# Without one of these nothing matches nearly everything.
_MAY_HAVE_GAP = re.compile(r"[.\[]|\\[SDWpP]")


def _class(chars: frozenset[str], negated: bool = False) -> str:
    """Java class of ASCII characters, or of all others."""
    return "[" + "^" * negated + "".join(dialect._char(c) for c in sorted(chars)) + "]"


def _chars(token: Token, dotall: bool) -> frozenset[str]:
    if token.kind == "any":
        return EVERYTHING if dotall else EVERYTHING - {"\n"}
    return dialect._chars(token, False)


def _is_gap(tokens: list[Token], k: int, dotall: bool) -> bool:
    """An unbounded repeat of nearly everything."""
    return (
        tokens[k].kind in ("set", "any") and k + 1 < len(tokens) and dialect._is_unbounded(tokens[k + 1])
        and OTHER in _chars(tokens[k], dotall)
    )


def _is_row(head: list[Token], dotall: bool) -> bool:
    """Characters one by one and runs of blanks, each ended by something else; word edges may stand between."""
    items = [t for t in head if t.kind != "edge"]
    if not items or items[0].kind != "lit" or any(t.kind not in ("lit", "set", "any", "repeat") for t in items):
        return False
    runs = any(t.kind == "repeat" for t in items)
    k = 0
    while k < len(items):
        chars = _chars(items[k], dotall)
        if items[k + 1:k + 2] and items[k + 1].kind == "repeat":
            follows = items[k + 2:k + 3]
            if k == 0 or not chars <= BLANKS or not follows or _chars(follows[0], dotall) & chars:
                return False
            if items[k + 3:k + 4] and items[k + 3].kind == "repeat":
                return False
            k += 2
            continue
        if runs and chars & BLANKS:
            return False
        k += 1
    return True


def linear_form(source: str) -> str | None:
    """The form of a pattern, or None where it is not of this shape."""
    if not _MAY_HAVE_GAP.search(source):
        return None
    flags = re.match(r"\(\?([ims]+)\)", source)
    given = set(flags[1]) if flags else set()
    if "i" in given:
        return None
    dotall = "s" in given
    tokens = dialect._tokens(source, flags.end() if flags else 0, "m" in given)
    if any(t.kind == "open" and t.char for t in tokens):
        return None
    gap = next((k for k in range(len(tokens)) if _is_gap(tokens, k, dotall)), None)
    if gap is None:
        return None
    head, tail = tokens[:gap], tokens[gap + 2:]
    if dialect._least(tokens, gap) > 1:
        return None
    stop = EVERYTHING - _chars(tokens[gap], dotall)
    if not stop or not _is_row(head, dotall) or head[-1].kind == "repeat":
        return None
    if any(_chars(t, dotall) & stop for t in head if t.kind in ("lit", "set", "any")):
        return None
    # No choice outside of groups, and nothing else that runs far.
    depth = 0
    for k, token in enumerate(tail):
        depth += {"open": 1, "close": -1}.get(token.kind, 0)
        if token.kind == "alt" and depth == 0 or _is_gap(tail, k, dotall):
            return None
    first = next((k for k, t in enumerate(tail) if t.kind != "edge"), None)
    if first is None or tail[first].kind not in ("lit", "set") or dialect._least(tail, first) != 1 or (
            tail[first + 1:first + 2] and tail[first + 1].kind == "repeat"):
        return None
    begins = _chars(tail[first], dotall)
    opening = _chars(next(t for t in head if t.kind == "lit"), dotall)
    if OTHER in begins | opening:
        return None

    at_least_one = dialect._least(tokens, gap) == 1
    one = dialect._emit([tokens[gap]]) if at_least_one else ""
    head_form, tail_form = dialect._emit(head) + one, dialect._emit(tail)
    skipped = rf"(?:{_class(stop | opening, True)}++|(?!{dialect._emit(head)}){_class(opening)})*+"
    rest = _class(stop, True) + "*+"
    prefix = "(?ds)" if dotall else "(?d)"
    if begins <= stop and first == 0:
        # Possessive, as the gap must end at the x that the tail begins with. With one character
        # at least in it, the first head is the one to try still: it has the longest gap.
        return rf"{prefix}((?:\G|{_class(stop)}){skipped})({head_form}{rest}{tail_form})"
    inside = frozenset().union(*[_chars(t, dotall) for t in tail if t.kind in ("lit", "set", "any")])
    if inside & stop or any(t.kind == "anchor" for t in tail):
        return None
    to_tail = rf"(?:{_class(stop | begins, True)}++|(?!{tail_form}){_class(begins)})*+{tail_form}"
    if tokens[gap + 1].jvm.endswith("?"):
        return rf"{prefix}((?:\G|{_class(stop)}){skipped})({head_form}{to_tail})"
    # A greedy gap runs to the last tail, behind which its segment has no other.
    return rf"{prefix}((?:\A|{_class(stop)}){skipped})({head_form}{to_tail}{rest})"
