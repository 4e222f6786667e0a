"""Rule patterns are written in RE2 syntax; Spark matches with java.util.regex.

``to_jvm`` rewrites the constructs whose meaning differs between the two, refuses
what RE2 does not have, and notes the literals that every match must contain, so
that a scan can test ``contains`` before it runs the regular expression.
"""

from __future__ import annotations

import re
import warnings
from dataclasses import dataclass
from functools import lru_cache

WORD = r"\w"  # ASCII in java.util.regex, unlike its \b
BLANK_SET = r"\t\n\f\r "
BLANK = f"[{BLANK_SET}]"

# POSIX class names of RE2 and their java.util.regex members.
POSIX = {
    "alnum": r"\p{Alnum}", "alpha": r"\p{Alpha}", "ascii": r"\p{ASCII}",
    "blank": r"\p{Blank}", "cntrl": r"\p{Cntrl}", "digit": r"\p{Digit}",
    "graph": r"\p{Graph}", "lower": r"\p{Lower}", "print": r"\p{Print}",
    "punct": r"\p{Punct}", "space": r"\p{Space}", "upper": r"\p{Upper}",
    "word": r"\w", "xdigit": r"\p{XDigit}",
}
# Scripts that may stand after \\p.
SCRIPTS = (
    "Arabic Armenian Bengali Bopomofo Braille Cherokee Common Coptic Cyrillic Devanagari Ethiopic Georgian Greek Gujarati "
    "Gurmukhi Han Hangul Hebrew Hiragana Inherited Kannada Katakana Khmer Lao Latin Malayalam Mongolian Myanmar Oriya Runic "
    "Sinhala Syriac Tamil Telugu Thaana Thai Tibetan Yi"
).split()
CONTROL = {"a": "\x07", "f": "\f", "t": "\t", "n": "\n", "r": "\r", "v": "\x0b"}
MAX_REPEAT = 1000
_HEX = re.compile(r"\\x(?:\{([0-9A-Fa-f]{1,6})\}|([0-9A-Fa-f]{2}))")
_OCTAL = re.compile(r"\\(?:0[0-7]{0,2}|[1-7][0-7]{1,2})")
_PROPERTY = re.compile(r"\\[pP](?:\{(\^?)([A-Z]\w*)\}|([CLMNPSZ]))")
_POSIX_NAME = re.compile(r"\[:(\^?)(\w+):\]")
_OPEN = re.compile(r"\((?:\?(?:P?<([A-Za-z]\w*)>|([is]*):))?")
_REPEAT = re.compile(r"(?:[*+?]|\{(\d+)(,?)(\d*)\})(\??)")
_TWO_PLAIN = re.compile(r"(?:\\b)?[A-Za-z0-9_ ]{2}")


class UnsupportedPattern(ValueError):
    """The pattern is not RE2, or uses a part of RE2 that is not translated."""


@dataclass(frozen=True)
class JvmRegex:
    pattern: str
    # Every match contains at least one string of each of these sets.
    required: tuple[tuple[str, ...], ...] = ()


@dataclass
class _Token:
    kind: str  # lit set any open close alt repeat edge anchor
    jvm: str
    char: str = ""
    least: int = 1


def _char(c: str) -> str:
    """One literal character in java.util.regex syntax, in or out of a class."""
    if ord(c) < 0x20 or ord(c) == 0x7F:
        return f"\\x{ord(c):02X}"
    return "\\" + c if c in r"\.[](){}*+?^$|&-#" else c


def _escape(src: str, i: int, in_class: bool) -> tuple[_Token, int]:
    """Read the escape at ``src[i] == '\\\\'``."""
    if i + 1 >= len(src):
        raise UnsupportedPattern("pattern ends in a backslash")
    c = src[i + 1]
    if c in CONTROL:
        return _Token("lit", _char(CONTROL[c]), CONTROL[c]), i + 2
    if c == "x":
        m = _HEX.match(src, i)
        if not m:
            raise UnsupportedPattern("bad \\x escape")
        ch = chr(int(m[1] or m[2], 16))
        return _Token("lit", _char(ch), ch), m.end()
    octal = _OCTAL.match(src, i)
    if octal:
        ch = chr(int(octal[0][1:], 8))
        return _Token("lit", _char(ch), ch), octal.end()
    if c in "dDwW":
        return _Token("set", "\\" + c), i + 2
    if c == "s":
        return _Token("set", BLANK_SET if in_class else BLANK), i + 2
    if c == "S":
        return _Token("set", f"[^{BLANK_SET}]"), i + 2
    if c in "pP":
        m = _PROPERTY.match(src, i)
        name = m and (m[2] or m[3])
        if not m or len(name) > 2 and name not in SCRIPTS:
            raise UnsupportedPattern("only general categories and common scripts are allowed after \\p")
        negated = (c == "P") != bool(m[1])
        return _Token("set", f"\\{'P' if negated else 'p'}{{{'Is' if len(name) > 2 else ''}{name}}}"), m.end()
    if not in_class and c in "bB":
        return _Token("edge", c), i + 2
    if not in_class and c in "Az":
        return _Token("anchor", "\\" + c), i + 2
    if c.isalnum():
        raise UnsupportedPattern(f"escape \\{c} is not RE2 or not supported")
    return _Token("lit", _char(c), c), i + 2


def _char_class(src: str, i: int) -> tuple[_Token, int]:
    """Read the class that starts at ``src[i] == '['``."""
    out, j = ["["], i + 1
    if src[j:j + 1] == "^":
        out.append("^")
        j += 1
    first = True
    while True:
        if j >= len(src):
            raise UnsupportedPattern("missing ]")
        c = src[j]
        if c == "]" and not first:
            return _Token("set", "".join(out) + "]"), j + 1
        first = False
        m = _POSIX_NAME.match(src, j)
        if m:
            if m[2] not in POSIX:
                raise UnsupportedPattern(f"unknown class [:{m[2]}:]")
            member = POSIX[m[2]]
            out.append(member.replace("\\p", "\\P").replace("\\w", "\\W") if m[1] else member)
            j = m.end()
        elif c == "\\":
            token, j = _escape(src, j, in_class=True)
            out.append(token.jvm)
        elif c == "-":
            out.append("-" if out[-1] not in ("[", "^") and src[j + 1:j + 2] not in ("]", "") else r"\-")
            j += 1
        else:
            out.append(_char(c))
            j += 1


def _tokens(src: str, i: int, multiline: bool) -> list[_Token]:
    out: list[_Token] = []
    while i < len(src):
        c = src[i]
        if c == "\\" and src.startswith("\\Q", i):
            end = src.find("\\E", i + 2)
            quoted = src[i + 2:end if end >= 0 else len(src)]
            out += [_Token("lit", _char(q), q) for q in quoted]
            i = end + 2 if end >= 0 else len(src)
            continue
        if c == "\\":
            token, i = _escape(src, i, in_class=False)
            out.append(token)
            continue
        if c == "[":
            token, i = _char_class(src, i)
            out.append(token)
            continue
        if c == "(":
            m = _OPEN.match(src, i)
            if src[m.end():m.end() + 1] == "?":
                raise UnsupportedPattern("lookaround, atomic groups and inner flags are not RE2 or not supported")
            flags = (m[2] or "").replace("i", "iu")
            out.append(_Token("open", "(" if m[2] is None else f"(?{flags}:", flags))
            i = m.end()
            continue
        repeat = _REPEAT.match(src, i) if c in "*+?{" else None
        if repeat:
            if not out or out[-1].kind in ("repeat", "open", "alt"):
                raise UnsupportedPattern("nothing to repeat, or a repeat of a repeat")
            if max(int(repeat[1] or 0), int(repeat[3] or 0)) > MAX_REPEAT:
                raise UnsupportedPattern(f"repeat count over {MAX_REPEAT}")
            least = int(repeat[1]) if repeat[1] else int(c == "+")
            out.append(_Token("repeat", repeat[0], least=least))
            i = repeat.end()
            continue
        if c == ")":
            out.append(_Token("close", c))
        elif c == "|":
            out.append(_Token("alt", c))
        elif c == ".":
            out.append(_Token("any", c))
        elif c == "^":
            out.append(_Token("anchor", r"(?:\A|(?<=\n))" if multiline else r"\A"))
        elif c == "$":
            out.append(_Token("anchor", r"(?=\n|\z)" if multiline else r"\z"))
        else:
            out.append(_Token("lit", _char(c), c))
        i += 1
    return out


def _group_end(tokens: list[_Token], start: int) -> int:
    depth = 0
    for k in range(start, len(tokens)):
        depth += {"open": 1, "close": -1}.get(tokens[k].kind, 0)
        if depth == 0:
            return k
    raise UnsupportedPattern("unbalanced parentheses")


def _least(tokens: list[_Token], k: int) -> int:
    """Smallest count of the item that ends at ``tokens[k]``."""
    follows = tokens[k + 1:k + 2]
    return follows[0].least if follows and follows[0].kind == "repeat" else 1


def _starts_with_word(tokens: list[_Token], k: int) -> bool:
    """True when whatever comes at position ``k`` surely starts with a word character."""
    if k >= len(tokens):
        return False
    token = tokens[k]
    if token.kind == "lit" or token.jvm in (r"\w", r"\d"):
        word = token.kind == "set" or re.fullmatch(WORD, token.char, re.ASCII) is not None
        return word and _least(tokens, k) > 0
    if token.kind == "open" and token.char == "":
        end = _group_end(tokens, k)
        depth, starts = 0, []
        for j in range(k, end):
            depth += {"open": 1, "close": -1}.get(tokens[j].kind, 0)
            if depth == 1 and (j == k or tokens[j].kind == "alt"):
                starts.append(j + 1)
        return _least(tokens, end) > 0 and all(_starts_with_word(tokens, j) for j in starts)
    return False


def _edge(tokens: list[_Token], k: int) -> str:
    """ASCII word boundary; the one-sided forms are cheaper where they are exact."""
    if tokens[k].jvm == "B":
        return f"(?:(?<={WORD})(?={WORD})|(?<!{WORD})(?!{WORD}))"
    if _starts_with_word(tokens, k + 1):
        return f"(?<!{WORD})"
    before = tokens[k - 1] if k else None
    if before and before.kind == "lit" and re.fullmatch(WORD, before.char, re.ASCII):
        return f"(?!{WORD})"
    return f"(?:(?<={WORD})(?!{WORD})|(?<!{WORD})(?={WORD}))"


def _literal_choice(tokens: list[_Token]) -> tuple[str, ...]:
    """The alternatives of a group body made of plain characters only, else ()."""
    if any(t.kind not in ("lit", "alt") for t in tokens):
        return ()
    choices = "".join("\0" if t.kind == "alt" else t.char for t in tokens).split("\0")
    return tuple(choices) if all(choices) else ()


def _required(tokens: list[_Token]) -> tuple[tuple[str, ...], ...]:
    found: list[tuple[str, ...]] = []
    run, k, depth = "", 0, 0
    while k < len(tokens):
        token = tokens[k]
        if token.kind == "alt":
            return ()
        if token.kind == "lit" and _least(tokens, k) > 0:
            run += token.char
            if tokens[k + 1:k + 2] and tokens[k + 1].kind == "repeat":
                found.append((run,))
                run = ""
        else:
            found.append((run,))
            run = ""
            if token.kind == "open":
                end = _group_end(tokens, k)
                if _least(tokens, end) > 0:
                    found.append(_literal_choice(tokens[k + 1:end]))
                k = end
        k += 1
    found.append((run,))
    found = [s for s in dict.fromkeys(found) if s and all(s)]
    long = [s for s in found if min(map(len, s)) >= 2]
    return tuple(long or found)


def _after_edge(tokens: list[_Token], k: int) -> tuple[str, int]:
    """A word boundary before literal text, as text first and a look back after it:
    the matcher then finds the text before it looks at what stands ahead of it.

    Returns the Java form and the next token, or an empty form when this does not fit.
    """
    end = k + 1
    while end < len(tokens) and tokens[end].kind == "lit":
        end += 1
    if end < len(tokens) and tokens[end].kind == "repeat":
        end -= 1
    if end > k + 1 and _starts_with_word(tokens, k + 1):
        run = "".join(t.jvm for t in tokens[k + 1:end])
        return f"{run}(?<!{WORD}{run})", end
    if k + 1 < len(tokens) and tokens[k + 1].jvm == "(" and _starts_with_word(tokens, k + 1):
        close = _group_end(tokens, k + 1)
        choices = _literal_choice(tokens[k + 2:close])
        if choices and tokens[close + 1:close + 2] and tokens[close + 1].kind != "repeat":
            first = "".join(_char(c) for c in sorted({c[0] for c in choices}))
            each = ["".join(map(_char, c)) for c in choices]
            body = "|".join(f"{c}(?<!{WORD}{c})" for c in each)
            # One look at the next character spares trying every choice at every place.
            return f"(?=[{first}])({body})", close + 1
    return "", k


# All ASCII characters, and one name for every other one.
OTHER = "other"
EVERYTHING = frozenset([*map(chr, range(128)), OTHER])


def _chars(token: _Token, folded: bool) -> frozenset[str]:
    """The characters a token can match, or more of them."""
    return _chars_of(token.kind, token.jvm, token.char, folded)


@lru_cache(maxsize=4096)
def _chars_of(kind: str, jvm: str, char: str, folded: bool) -> frozenset[str]:
    if kind == "lit":
        found = {char if ord(char) < 128 else OTHER}
    elif kind == "set" and not re.search(r"\\[pP]|.\[|[^\x00-\x7F]", jvm):
        member = re.compile(jvm, re.ASCII)
        found = {c for c in map(chr, range(128)) if member.match(c)}
        if re.match(r"\[\^|\\[DW]|\[.*\\[DWS]", jvm):
            found.add(OTHER)
    else:
        return EVERYTHING
    if folded:
        plain = found - {OTHER}
        found |= {c.lower() for c in plain} | {c.upper() for c in plain}
        # Three letters are the other case of characters outside ASCII, too.
        found |= {OTHER} if found & set("iks") else set()
    return frozenset(found)


def _items(tokens: list[_Token], folded: bool) -> list[tuple[frozenset[str], int, bool]] | None:
    """A sequence of single characters as (what it matches, least count, any number of it); None if it is more than that."""
    found, k = [], 0
    while k < len(tokens):
        if tokens[k].kind not in ("lit", "set", "any"):
            return None
        least, fixed = 1, True
        follows = tokens[k + 1:k + 2]
        if follows and follows[0].kind == "repeat":
            least, fixed = follows[0].least, False
        found.append((_chars(tokens[k], folded), least, fixed))
        k += 1 if fixed else 2
    return found


def _first(items: list[tuple[frozenset[str], int, bool]], after: frozenset[str]) -> frozenset[str]:
    """What a sequence can start with, given what can follow it."""
    found: frozenset[str] = frozenset()
    for chars, least, _ in items:
        found |= chars
        if least > 0:
            return found
    return found | after


def _alternatives(tokens: list[_Token]) -> list[list[_Token]]:
    parts: list[list[_Token]] = [[]]
    for token in tokens:
        if token.kind == "alt":
            parts.append([])
        else:
            parts[-1].append(token)
    return parts


def _is_unbounded(token: _Token) -> bool:
    return token.kind == "repeat" and re.fullmatch(r"(?:[*+]|\{\d+,\})\??", token.jvm) is not None


def _repeated_group(tokens: list[_Token], start: int, end: int, folded: bool) -> str:
    """A group that is repeated without a bound.

    Java matches such a group by one call inside the other for each repeat, and a long
    text overflows the stack. Three forms do not: a choice of single characters is a
    class; a group of fixed length without a choice is a loop; and where a text can be cut
    into repeats in one way only and what follows cannot start a repeat, the repeat is
    made possessive, which then matches the same. Other groups are refused.
    """
    repeat, body = tokens[end + 1], tokens[start + 1:end]
    folded = folded or "i" in tokens[start].char
    choices = _alternatives(body)
    if all(len(c) == 1 and c[0].kind in ("lit", "set") for c in choices):
        one = "[" + "".join(c[0].jvm for c in choices) + "]" if len(choices) > 1 else choices[0][0].jvm
        opening = tokens[start].jvm if tokens[start].char else "(?:"
        return f"{opening}{one})" + repeat.jvm if tokens[start].char else one + repeat.jvm
    if len(choices) == 1 and all(t.kind in ("lit", "set", "any") for t in body):
        return tokens[start].jvm + _emit(body, folded) + ")" + repeat.jvm
    rest: list[_Token] = []
    for token in tokens[end + 2:]:
        if token.kind in ("open", "close", "alt", "edge", "anchor"):
            # The item before it may be all that is needed; else anything can follow.
            rest.append(_Token("any", "."))
            break
        rest.append(token)
    # At the end of the pattern nothing has to follow.
    after = _first(_items(rest, folded) or [], frozenset())
    sequences = [_items(c, folded) for c in choices]
    if repeat.jvm.endswith("?") or any(s is None or not any(least for _, least, _ in s) for s in sequences):
        raise UnsupportedPattern("an unbounded repeat of a group with a choice, a group or a lazy repeat in it")
    starts = [_first(s, EVERYTHING) for s in sequences]
    again = after.union(*starts)
    clear = not after & frozenset().union(*starts) and all(
        not one & other for i, one in enumerate(starts) for other in starts[:i])
    for sequence in sequences:
        for k, (chars, _, fixed) in enumerate(sequence):
            clear = clear and (fixed or not chars & _first(sequence[k + 1:], again))
    if not clear:
        raise UnsupportedPattern("an unbounded repeat of a group that can match one text in several ways")
    opening = f"(?{tokens[start].char}:" if tokens[start].char else "(?:"
    return opening + _emit(body, folded) + ")" + repeat.jvm + "+"


def _emit(tokens: list[_Token], folded: bool = False) -> str:
    out, k = [], 0
    while k < len(tokens):
        if tokens[k].kind == "edge":
            form, following = _after_edge(tokens, k) if tokens[k].jvm == "b" else ("", k)
            out.append(form or _edge(tokens, k))
            k = following if form else k + 1
            continue
        if tokens[k].kind == "open":
            end = _group_end(tokens, k)
            if end + 1 < len(tokens) and _is_unbounded(tokens[end + 1]):
                out.append(_repeated_group(tokens, k, end, folded))
                k = end + 2
                continue
        out.append(tokens[k].jvm)
        k += 1
    return "".join(out)


def to_jvm(source: str) -> JvmRegex:
    """Translate one RE2 pattern. Raises UnsupportedPattern."""
    flags = re.match(r"\(\?([ims]+)\)", source)
    given = set(flags[1]) if flags else set()
    tokens = _tokens(source, flags.end() if flags else 0, "m" in given)
    depth = 0
    for token in tokens:
        depth += {"open": 1, "close": -1}.get(token.kind, 0)
        if depth < 0:
            raise UnsupportedPattern("unbalanced parentheses")
    if depth:
        raise UnsupportedPattern("unbalanced parentheses")
    prefix = "(?d" + ("iu" if "i" in given else "") + ("s" if "s" in given else "") + ")"
    folded = "i" in given or any(t.kind == "open" and "i" in t.char for t in tokens)
    return JvmRegex(prefix + _emit(tokens, folded), () if folded else _required(tokens))


def can_match_nothing(source: str) -> bool:
    """True when the pattern has a match without characters (RE2 and Java then differ)."""
    if "|" not in source and _TWO_PLAIN.match(source):
        # No choice, and a character ahead of another one, which nothing repeats: every match has it.
        return False
    plain = re.sub(r"\\Q(.*?)(?:\\E|\Z)", lambda m: re.escape(m[1]), source, flags=re.DOTALL).replace(r"\z", r"\Z")
    plain = re.sub(r"\[\[:\^?\w+:\]\]|\\[pP](?:\{\^?\w+\}|\w)", "x", plain)
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore", FutureWarning)
            return any(m.start() == m.end() for probe in ("", "a", " ", "a b\n") for m in re.finditer(plain, probe))
    except re.error:
        return False
