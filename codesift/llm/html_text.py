"""Main text of web pages by differencing each page with its nearest by URL.

1. A page is cut into lines, one for each block element. Elements that are never text
   (scripts, styles, forms, menus, headers, footers, sidebars, and those whose class, id or role
   names an advert, a notice, comments and the like) are left out.
   If the page marks its main text (``article``, ``main``), only lines inside the marks are kept.
2. Pages of a host are put in the order of their paths by a range partitioning, in which a
   host of any size is spread over many tasks. Adjacent pages with equal lines are copies of
   each other and form one run; the runs at the ends of the partitions meet in a small
   table, so a run may lie over many partitions.
3. A page is aligned with the nearest page on either side that is not a copy of it by a
   longest common subsequence of their lines; if it has none on one side, with the nearest
   two on the other side. Lines that they share are template text and deleted. A page that
   has nearly all lines of the other may be a near copy or share a large template, so what it
   shares goes only if the second page shares it too.

A mark is a guard, for near copies and passages that many texts have are text: a line inside it goes only if the ten nearest
pages, five on each side unless the host ends there, share it at the same distance from the first or from the last
line, and none of them has nearly all lines of the mark. A page whose host has no other than copies keeps its lines. Only hashes of lines move in steps 2 and 3.

Defined cases: a null or empty page has empty text; a null URL has an empty host and
path; repeated rows and equal URLs are neighbours of each other, and copies as above;
unclosed elements end where HTML lets them end, and a page of any length is read whole.
Only the columns named are read.
"""

from __future__ import annotations

import hashlib
import html
import re
import zlib
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import zip_longest

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, BooleanType, LongType, StringType, StructType

from codesift.llm.common import stored

COPY_SHARE = 0.8

# Elements of HTML by what they mean for the text.
RAW = {"script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
LEFT_OUT = RAW | {
    "head", "nav", "footer", "aside", "form", "noscript", "template", "svg", "math", "canvas", "object", "button", "select",
    "menu", "dialog", "audio", "video", "fieldset", "map",
}
MARKS = {"article", "main"}
INLINE = {
    "a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd",
    "label", "mark", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var",
} | (VOID - {"hr"})
# An opening tag of the key ends an open element of the value.
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
# Parts of class, id and role names that say what an element is for.
NOISE = {
    "ad", "ads", "advert", "adverts", "advertisement", "sponsor", "sponsored", "promo", "banner", "cookie", "cookies", "consent",
    "gdpr", "notice", "alert", "popup", "modal", "overlay", "sidebar", "menu", "navbar", "nav", "navigation", "breadcrumb",
    "breadcrumbs", "pagination", "footer", "comments", "comment", "disqus", "share", "sharing", "social", "related",
    "newsletter", "subscribe", "login", "signup", "search", "complementary", "contentinfo", "dialog", "masthead",
}

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[(?P<data>.*?)(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(?P<end>/?)(?P<tag>[A-Za-z][^\s/>]*)(?P<attributes>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|</?[A-Za-z][^>]*>", re.DOTALL)
NAMES = re.compile(r"(?:^|\s)(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.IGNORECASE)
PARTS = re.compile(r"[^a-z]+")
NO_TAG = re.compile(r"<(?=/?[A-Za-z])")


def _is_noise(tag: str, attributes: str) -> bool:
    if tag in LEFT_OUT:
        return True
    if tag in ("body", "html") or not attributes:
        return False
    named = " ".join(a or b or c for a, b, c in NAMES.findall(attributes)).lower()
    return bool(named) and not NOISE.isdisjoint(PARTS.split(named))


def _with_end(text: str) -> set[int]:
    """Where the opening tags stand that have an end tag of their own."""
    opened: dict[str, list[int]] = {}
    found: set[int] = set()
    at = 0
    while (token := TOKEN.search(text, at)) is not None:
        at = token.end()
        tag = (token["tag"] or "").lower()
        if not tag:
            continue
        if token["end"]:
            if opened.get(tag):
                found.add(opened[tag].pop())
        elif tag in RAW:
            ended = re.compile(rf"</{tag}(?=[\s/>])[^>]*>?", re.IGNORECASE).search(text, at)
            at = ended.end() if ended else len(text)
        else:
            opened.setdefault(tag, []).append(token.start())
    return found


def page_lines(page: str | None) -> tuple[list[str], bool]:
    """The lines of a page and whether they stand inside a mark of the main text.

    An ``article`` inside a sidebar or comments that have an end is theirs, unless the page has no other line.
    """
    lines, marked, passed = _lines_of(page or "", False)
    if passed and not lines:
        lines, marked, _ = _lines_of(page or "", True)
    return lines, marked


def _lines_of(text: str, reopen: bool) -> tuple[list[str], bool, bool]:
    """Lines, whether they are marked, and whether a mark was passed over."""
    lines: list[tuple[str, bool]] = []
    held: list[str] = []
    # Open elements: name, whether it is left out, and where it stands; the depths of each name, and of those left out.
    opened: list[tuple[str, bool, int]] = []
    depths: defaultdict[str, list[int]] = defaultdict(list)
    left_out: list[int] = []
    marks = 0
    # Opening tags with an end tag, and how many of the elements left out are among them.
    with_end: set[int] | None = None
    ended_out = 0
    passed = False
    # No tag begins behind the last end of one; looking for its end again and again would take quadratic time.
    last = text.rfind(">") + 1
    if "<![CDATA[" not in text[last:]:
        text = text[:last] + NO_TAG.sub("&lt;", text[last:])

    def flush() -> None:
        line = " ".join(html.unescape("".join(held)).split())
        if line:
            lines.append((line, marks > 0))
        held.clear()

    def close_to(depth: int) -> None:
        nonlocal ended_out, marks
        while len(opened) > depth:
            tag, noise, start = opened.pop()
            depths[tag].pop()
            if noise:
                left_out.pop()
                ended_out -= with_end is not None and start in with_end
            marks -= tag in MARKS

    def last_open(tags: set[str], until: set[str]) -> int:
        deepest = lambda names: max((depths[n][-1] for n in names if depths.get(n)), default=-1)
        depth = deepest(tags)
        return depth if depth > deepest(until - tags) else -1

    at, seen_mark = 0, False
    while at < len(text):
        token = TOKEN.search(text, at)
        if token is None:
            if not left_out:
                held.append(text[at:])
            break
        if not left_out and token.start() > at:
            held.append(text[at:token.start()])
        at = token.end()
        tag = (token["tag"] or "").lower()
        if not tag:
            if token["data"] and not left_out:
                held.append(html.escape(token["data"]))
            continue
        if token["end"]:
            if tag not in INLINE and not left_out:
                flush()
            depth = last_open({tag}, set())
            if depth >= 0 and tag not in VOID:
                close_to(depth)
            continue
        noise = _is_noise(tag, token["attributes"])
        if tag in RAW:
            # The content of these is not markup; it ends at the closing tag only.
            ended = re.compile(rf"</{tag}(?=[\s/>])[^>]*>?", re.IGNORECASE).search(text, at)
            at = ended.end() if ended else len(text)
            if not left_out and tag not in INLINE:
                flush()
            continue
        if tag in VOID:
            if not left_out:
                held.append(" ") if tag in INLINE else flush()
            continue
        if tag not in INLINE:
            if not left_out:
                flush()
            depth = last_open(ENDS.get(tag, {"p"}), {"ul", "ol", "table", "dl", "article", "main", "section", "div", "td"})
            if depth >= 0:
                close_to(depth)
        if tag in MARKS and not noise:
            # The main text is not part of a menu or footer that was left open.
            if left_out and not marks:
                if with_end is None:
                    with_end = _with_end(text)
                    ended_out = sum(opened[d][2] in with_end for d in left_out)
                if tag == "main" or reopen or not ended_out:
                    close_to(left_out[0])
                else:
                    noise = passed = True
            seen_mark = seen_mark or not noise
        if tag == "header" and not marks:
            noise = True
        depths[tag].append(len(opened))
        if noise:
            left_out.append(len(opened))
            ended_out += with_end is not None and token.start() in with_end
        opened.append((tag, noise, token.start()))
        marks += tag in MARKS
    flush()
    if seen_mark and any(inside for _, inside in lines):
        return [line for line, inside in lines if inside], True, passed
    return [line for line, _ in lines], False, passed


def _lengths(own: list[int], other: list[int]) -> np.ndarray:
    """Lengths of the common subsequence of ``own`` and every beginning of ``other``, by bits."""
    masks: dict[int, int] = {}
    for place, line in enumerate(other):
        masks[line] = masks.get(line, 0) | 1 << place
    full = (1 << len(other)) - 1
    row = full
    for line in own:
        hit = row & masks.get(line, 0)
        row = ((row + hit) | (row - hit)) & full
    bits = np.unpackbits(np.frombuffer(row.to_bytes(len(other) // 8 + 1, "little"), np.uint8), bitorder="little")
    return np.concatenate([[0], np.cumsum(1 - bits[:len(other)].astype(np.int64))])


def shared_lines(own: list[int], other: list[int]) -> list[int]:
    """Places in ``own`` of a longest common subsequence with ``other``.

    The lists are halved until one line is left, so memory stays linear.
    """
    common = set(own) & set(other)
    places = [i for i, line in enumerate(own) if line in common]
    found: list[int] = []
    todo = [(places, [line for line in other if line in common])]
    while todo:
        left, right = todo.pop()
        while left and right and own[left[0]] == right[0]:
            found.append(left[0])
            left, right = left[1:], right[1:]
        while left and right and own[left[-1]] == right[-1]:
            found.append(left[-1])
            left, right = left[:-1], right[:-1]
        if not left or not right:
            continue
        if len(left) == 1:
            found += left if own[left[0]] in right else []
            continue
        half = len(left) // 2
        before = _lengths([own[i] for i in left[:half]], right)
        after = _lengths([own[i] for i in left[:half - 1:-1]], right[::-1])[::-1]
        cut = int((before + after).argmax())
        todo += [(left[:half], right[:cut]), (left[half:], right[cut:])]
    return sorted(found)


def _at_one_place(own: list[int], other: list[int], place: int) -> bool:
    """Does the other page have the line of ``place`` as far from its first or last line?"""
    from_end = len(other) - len(own) + place
    return place < len(other) and other[place] == own[place] or 0 <= from_end and other[from_end] == own[place]


def template_lines(own: list[int], others: list[list[int]], marked: bool) -> list[int]:
    """Places in ``own`` of lines that the nearest pages show to be template text.

    Two pages are asked, for lines inside a mark ``MARK_WITNESSES``, fewer only at the end of the host.
    """
    if not others or marked and len(others) < MARK_WITNESSES:
        return []
    if marked:
        # Text may repeat, too: the line must stand in all of them at one place. Few lines do, and few pages are aligned.
        fixed = [i for i in range(len(own)) if all(_at_one_place(own, other, i) for other in others)]
        if not fixed:
            return []
    shared = [set(shared_lines(own, other)) for other in others]
    near_copy = [len(s) > COPY_SHARE * len(own) for s in shared]
    if marked:
        return [] if any(near_copy) else [i for i in fixed if all(i in s for s in shared)]
    if len(shared) == 1:
        # One page alone: if either has no own line, it says nothing about a template.
        (s,) = shared
        return [] if len(s) in (len(own), len(others[0])) else sorted(s)
    both = shared[0] & shared[1]
    return sorted(set().union(*(both if near else s for s, near in zip(shared, near_copy, strict=True))))


PARSED = StructType().add("packed", BinaryType()).add("hashes", ArrayType(LongType())).add("marked", BooleanType())


def _line_hash(line: str) -> int:
    return int.from_bytes(hashlib.blake2b(line.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big", signed=True)


@F.pandas_udf(PARSED)
def _parsed(pages: pd.Series) -> pd.DataFrame:
    """The lines of each page, packed because they are stored and shuffled, and their hashes."""
    found = [page_lines(page) for page in pages]
    return pd.DataFrame({
        "packed": [zlib.compress("\n".join(lines).encode("utf-8", "surrogatepass")) for lines, _ in found],
        "hashes": [[_line_hash(line) for line in lines] for lines, _ in found],
        "marked": [marked for _, marked in found],
    })


@F.pandas_udf(StringType())
def _kept_text(packed: pd.Series, deleted: pd.Series) -> pd.Series:
    def text(lines: bytes, gone) -> str:
        whole = zlib.decompress(lines).decode("utf-8", "surrogatepass")
        if gone is None or not len(gone):
            return whole
        without = set(gone)
        return "\n".join(line for i, line in enumerate(whole.split("\n")) if i not in without)

    return pd.Series([text(*pair) for pair in zip(packed, deleted, strict=True)], dtype=object)


# A page (``uid`` and more), what is deleted in a run, or a run at the end of a partition (``host, hashes``).
FOUND = "part int, run int, uid long, marked boolean, deleted array<int>, host string, hashes array<long>"
JUDGED = "part int, run int, marked boolean, deleted array<int>"
# Pages asked about lines inside a mark. Runs that near an end of a partition have neighbours in another one,
# and END runs are needed there to judge them.
MARK_WITNESSES = 10
END = 2 * MARK_WITNESSES


@dataclass
class _Run:
    """Adjacent pages of a host with equal lines; ``kinds`` are the marks that its pages have."""

    host: str
    hashes: list[int]
    number: int
    kinds: set[bool] = field(default_factory=set)


def _witnesses(runs: list[_Run], at: int, marked: bool) -> list[list[int]]:
    """Lines of the runs of the host that are nearest to the one at ``at``, from both sides in turn; equal ones count once."""
    own, found = runs[at], []
    before = [r.hashes for r in runs[max(0, at - MARK_WITNESSES):at][::-1] if r.host == own.host]
    after = [r.hashes for r in runs[at + 1:at + 1 + MARK_WITNESSES] if r.host == own.host]
    most = MARK_WITNESSES if marked else 2
    for pair in zip_longest(before, after):
        for lines in pair:
            if lines is not None and lines != own.hashes and lines not in found and len(found) < most:
                found.append(lines)
    return found


def _deletions(runs: list[_Run], at: int) -> Iterator[tuple[bool, list[int]]]:
    for marked in sorted(runs[at].kinds):
        deleted = template_lines(runs[at].hashes, _witnesses(runs, at, marked), marked)
        if deleted:
            yield marked, deleted


def _within_partition(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Sorted pages in; out come the run of each page, what goes in the runs inside the partition, and the runs at its ends."""
    runs: list[_Run] = []
    out: list[tuple] = []
    part = 0

    def frame() -> pd.DataFrame:
        rows = pd.DataFrame(out, columns=["part", "run", "uid", "marked", "deleted", "host", "hashes"]).astype(
            {"uid": "Int64", "part": "Int32", "run": "Int32", "marked": "boolean"})
        out.clear()
        return rows

    def as_rows(run: _Run) -> list[tuple]:
        return [(part, run.number, None, marked, None, run.host, run.hashes) for marked in sorted(run.kinds)]

    for batch in batches:
        for page in batch.itertuples(index=False):
            part, hashes = page.part, list(page.hashes)
            if not runs or runs[-1].host != page.host or runs[-1].hashes != hashes:
                at = len(runs) - 1 - MARK_WITNESSES
                # The last run is complete, and with it the neighbours of one before.
                if at >= 0 and runs[at].number >= MARK_WITNESSES:
                    out += [(part, runs[at].number, None, marked, deleted, None, None) for marked, deleted in _deletions(runs, at)]
                if runs and runs[-1].number < END:
                    out += as_rows(runs[-1])
                runs.append(_Run(page.host, hashes, runs[-1].number + 1 if runs else 0))
                del runs[:-1 - END]
            runs[-1].kinds.add(page.marked)
            out.append((part, runs[-1].number, page.uid, page.marked, None, None, None))
        yield frame()
    last = runs[-1].number if runs else -1
    for at, run in enumerate(runs):
        if last - MARK_WITNESSES == run.number >= MARK_WITNESSES:
            out += [(part, run.number, None, marked, deleted, None, None) for marked, deleted in _deletions(runs, at)]
        if run.number > last - END and (run.number >= END or run is runs[-1]):
            out += as_rows(run)
    yield frame()


def _at_the_ends(rows: pd.DataFrame) -> pd.DataFrame:
    """The runs at the ends of the partitions, of one host: what they delete."""
    runs: list[_Run] = []
    own: list[list[tuple[int, int]]] = []
    last: dict[int, int] = {}
    for row in rows.sort_values(["part", "run"]).itertuples(index=False):
        hashes = list(row.hashes)
        if not runs or runs[-1].hashes != hashes:
            runs.append(_Run(row.host, hashes, len(runs)))
            own.append([])
        runs[-1].kinds.add(row.marked)
        if (row.part, row.run) not in own[-1][-1:]:
            own[-1].append((row.part, row.run))
        last[row.part] = row.last
    found = []
    for at in range(len(runs)):
        ends = [(part, run) for part, run in own[at] if run < MARK_WITNESSES or run > last[part] - MARK_WITNESSES]
        if ends:
            found += [(part, run, marked, deleted) for marked, deleted in _deletions(runs, at) for part, run in ends]
    return pd.DataFrame(found, columns=["part", "run", "marked", "deleted"])


def _deleted(parsed: DataFrame) -> DataFrame:
    """``uid, deleted`` of every page that has lines to delete."""
    order = ["host", "path", "page_id", "uid"]
    ordered = parsed.where(F.size("hashes") > 0).select(*order, "marked", "hashes").repartitionByRange(*order).sortWithinPartitions(*order)
    found = stored(ordered.withColumn("part", F.spark_partition_id()).mapInPandas(_within_partition, FOUND), "html-neighbours")
    pages = found.where(F.col("uid").isNotNull()).select("part", "run", "marked", "uid")
    # At most 4 * END rows for each partition.
    ends = found.where(F.col("host").isNotNull()).select("part", "run", "marked", "host", "hashes")
    last = pages.groupBy("part").agg(F.max("run").alias("last"))
    judged = ends.join(last, "part").groupBy("host").applyInPandas(_at_the_ends, JUDGED)
    inside = found.where(F.col("deleted").isNotNull()).select("part", "run", "marked", "deleted")
    return pages.join(judged.unionByName(inside), ["part", "run", "marked"]).select("uid", "deleted")


def main_text(pages: DataFrame, page_id: str = "page_id", url: str = "url", page: str = "html") -> DataFrame:
    """``page_id, url, text, n_chars, n_deleted`` for every row of ``pages``."""
    whole_url = F.coalesce(F.col(url), F.lit(""))
    parsed = stored(pages.select(
        F.col(page_id).alias("page_id"), F.col(url).alias("url"), _parsed(F.col(page)).alias("found"),
        F.lower(F.regexp_extract(whole_url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)).alias("host"),
        F.regexp_extract(whole_url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1).alias("path"),
    ).select(
        "page_id", "url", "host", "path", "found.*", F.monotonically_increasing_id().alias("uid"),
    ), "html-lines")
    judged = parsed.select("page_id", "url", "packed", "uid").join(_deleted(parsed), "uid", "left")
    n_deleted = F.when(F.col("deleted").isNull(), 0).otherwise(F.size("deleted")).cast("long")
    return judged.select("page_id", "url", _kept_text("packed", "deleted").alias("text"), n_deleted.alias("n_deleted")).select(
        "page_id", "url", "text", F.length("text").cast("long").alias("n_chars"), "n_deleted",
    )
