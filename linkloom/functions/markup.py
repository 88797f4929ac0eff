"""Wiki and HTML markup: stripping, blanking, sentences, definitions."""

from __future__ import annotations

import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# --- rules that are one pattern: column expressions -------------------------------------------------------------


def strip_comments(c: Column) -> Column:
    return F.regexp_replace(c, r"(?s)<!--.*?-->", "")


def strip_refs(c: Column) -> Column:
    """References with a text and empty ones."""
    return F.regexp_replace(F.regexp_replace(c, r"(?is)<ref[^<>]*/>", ""), r"(?is)<ref\b[^<>]*>.*?</ref\s*>", "")


def strip_html(c: Column) -> Column:
    """Tags, their contents stay."""
    return F.regexp_replace(c, r"</?[A-Za-z][^<>]*>", "")


def strip_external_links(c: Column) -> Column:
    """[address label] becomes the label, [address] nothing."""
    return F.regexp_replace(F.regexp_replace(c, r"\[(?:https?|ftp)://[^\s\]]+\s+([^\]]*)\]", "$1"), r"\[(?:https?|ftp)://[^\s\]]+\]", "")


def strip_formatting(c: Column) -> Column:
    """Marks of bold and italics."""
    return F.regexp_replace(c, r"'{2,}", "")


def strip_headings(c: Column) -> Column:
    """Lines that are headings."""
    return F.regexp_replace(c, r"(?m)^=+[^=\n]+=+[ \t]*$", "")


def strip_list_items(c: Column) -> Column:
    """Lines that are list entries or indented by colons."""
    return F.regexp_replace(c, r"(?m)^[*#:;]+[^\n]*$", "")


def strip_magic_words(c: Column) -> Column:
    """__SWITCHES__."""
    return F.regexp_replace(c, r"__[A-Z]+__", "")


def strip_orphaned_brackets(c: Column) -> Column:
    """Brackets of links and templates that are left."""
    return F.regexp_replace(c, r"\[\[|\]\]|\{\{|\}\}|\{\||\|\}", "")


def strip_excess_newlines(c: Column) -> Column:
    """At most one blank line at a time."""
    return F.regexp_replace(c, r"\n(?:[ \t]*\n){2,}", "\n\n")


# --- rules that nest: one scanner --------------------------------------------------------------------------------


def _pairs(s: str, a: str, b: str) -> list[tuple[int, int]]:
    """(start of a, end of b) of every matched pair, in the order of their ends; marks without a partner are in none. One pass with a stack."""
    starts: list[int] = []
    out = []
    for m in re.finditer(f"{re.escape(a)}|{re.escape(b)}", s):
        if m.group() == a:
            starts.append(m.start())
        elif starts:
            out.append((starts.pop(), m.end()))
    return out


def balanced(s: str, a: str, b: str, inner: Callable[[str], str]) -> str:
    """Each outermost stretch between a and b replaced by inner(what stands between); unbalanced marks stay and hide no pair."""
    outer: list[tuple[int, int]] = []
    for i, e in _pairs(s, a, b):
        while outer and outer[-1][0] > i:
            outer.pop()
        outer.append((i, e))
    out, done = [], 0
    for i, e in outer:
        out += [s[done:i], inner(s[i + len(a) : e - len(b)])]
        done = e
    return "".join(out) + s[done:]


def from_inside(s: str, a: str, b: str, inner: Callable[[str], str]) -> str:
    """Every stretch between a and b replaced by inner(what stands between), the innermost first; unbalanced marks stay."""
    pairs = _pairs(s, a, b)
    if not pairs:
        return s
    marks = sorted([(i, 1) for i, _ in pairs] + [(e - len(b), 0) for _, e in pairs])
    open_: list[list[str]] = [[]]
    done = 0
    for at, opens in marks:
        open_[-1].append(s[done:at])
        done = at + len(a if opens else b)
        if opens:
            open_.append([])
        else:
            x = "".join(open_.pop())
            open_[-1].append(inner(x))
    return "".join(open_[0]) + s[done:]


def between(s: str, start: re.Pattern, end: re.Pattern, put: Callable[[str], str] = lambda x: "") -> str:
    """Each stretch from a match of `start` to the next of `end` replaced; a start without an end stays. One pass."""
    out, i = [], 0
    while m := start.search(s, i):
        e = end.search(s, m.end())
        if not e:
            break
        out += [s[i : m.start()], put(s[m.start() : e.end()])]
        i = e.end()
    return "".join(out) + s[i:] if out else s


def strip_templates(s: str) -> str:
    return balanced(s, "{{", "}}", lambda _: "")


def strip_tables(s: str) -> str:
    return balanced(s, "{|", "|}", lambda _: "")


def _label(x: str) -> str:
    """A link's text: what stands after the last bar."""
    return x.rpartition("|")[2] if "|" in x[1:] else x


def strip_links(s: str) -> str:
    """Links become their texts, links in links too."""
    return from_inside(s, "[[", "]]", _label) if "[[" in s else s


def _prefix(x: str) -> str:
    head = x.partition("|")[0]
    return head.partition(":")[0].strip().lower() if ":" in head else ""


def strip_images(s: str) -> str:
    """Links to files and images go, others stay."""
    return balanced(s, "[[", "]]", lambda x: "" if _prefix(x) in ("file", "image", "media") else f"[[{x}]]")


def strip_other_links(s: str) -> str:
    """Links with a prefix (categories, languages) go, links to articles stay."""
    return balanced(s, "[[", "]]", lambda x: "" if _prefix(x) else f"[[{x}]]")


def strip_lone_links(s: str) -> str:
    """Lines that hold nothing but a link go."""
    return re.sub(r"(?m)^[ \t]*\[\[[^\[\]\n]*\]\][ \t]*\n?", "", s)


def strip_section(s: str, name: str) -> str:
    """A section up to the next heading of its level; the last one up to the end of its first paragraph."""
    m = re.search(rf"(?mi)^(=+)[ \t]*{re.escape(name)}[ \t]*\1[ \t]*$", s)
    if not m:
        return s
    nxt = re.search(rf"(?m)^{m[1]}[^=\n].*$", s[m.end() :])
    if nxt:
        return s[: m.start()] + s[m.end() + nxt.start() :]
    end = re.search(r"\S[^\n]*(?:\n[ \t]*\S[^\n]*)*", s[m.end() :])
    return s[: m.start()] + (s[m.end() + end.end() :] if end else "")


def strip_indented_start(s: str) -> str:
    """Without the lines at the start that are blank, indented, list entries or begin with no word."""
    lines = s.split("\n")
    for i, x in enumerate(lines):
        if re.match(r"['\"\[(]*\w", x):
            return "\n".join(lines[i:])
    return ""


def _formatting(s: str) -> str:
    return re.sub(r"'{2,}", "", s)


_COMMENT, _COMMENT_END = re.compile("<!--"), re.compile("-->")
_REF, _REF_END = re.compile(r"(?i)<ref\b[^<>]*>"), re.compile(r"(?i)</ref\s*>")
_LINK_TAG, _LINK_END = re.compile(r"(?i)<a\b[^<>]*>"), re.compile(r"(?i)</a\s*>")

_PLAIN: list[Callable[[str], str]] = [
    lambda s: between(s, _COMMENT, _COMMENT_END),
    lambda s: re.sub(r"(?is)<ref\b[^<>]*/>", "", s),
    lambda s: between(s, _REF, _REF_END),
    strip_templates,
    strip_tables,
    strip_images,
    strip_other_links,
    strip_links,
    lambda s: re.sub(r"\[(?:https?|ftp)://[^\s\]]+\s*([^\]]*)\]", r"\1", s),
    lambda s: re.sub(r"</?[A-Za-z][^<>]*>", "", s),
    _formatting,
    lambda s: re.sub(r"__[A-Z]+__", "", s),
]


def strip_everything(s: str) -> str:
    """Plain text: no comments, references, templates, tables, links, tags, marks, headings, list marks or excess lines."""
    for f in _PLAIN:
        s = f(s)
    s = re.sub(r"(?m)^=+[^=\n]+=+[ \t]*$", "", s)
    s = re.sub(r"(?m)^[*#:;]+[ \t]*", "", s)
    s = re.sub(r"\[\[|\]\]|\{\{|\}\}|\{\||\|\}", "", s)
    return re.sub(r"\n(?:[ \t]*\n){2,}", "\n\n", s).strip()


def strip_to_links(s: str, marks: bool = False) -> str:
    """Plain text in which links to articles stay, and with `marks` bold and italics."""
    for f in _PLAIN:
        if f is not strip_links and not (marks and f is _formatting):
            s = f(s)
    return re.sub(r"\n(?:[ \t]*\n){2,}", "\n\n", s).strip()


# --- sentences and definitions ------------------------------------------------------------------------------------

# Abbreviations after which a sentence goes on.
HONORIFICS = frozenset("mr mrs ms dr prof rev gen sen rep gov capt col lt sgt st jr sr hon messrs mt ft no vs cf ca approx fig vol ed eds pp".split())
INITIALS = re.compile(r"(?:^|[\s(])(?:[A-Z]\.|(?:[A-Za-z]\.){2,})$")
_END = re.compile(r"[.!?]+[\"')\]]*(?=\s|$)")
_NEXT = re.compile(r"\S")


def sentences(s: str, question_marks: bool = True) -> list[str]:
    """The sentences of a text; links are never broken, nor honorifics, initials or numbers.

    A sentence ends at a full stop, exclamation or (unless switched off) question mark before white space, if the
    next word does not go on in lower case.
    """
    masked = re.sub(r"\[\[[^\[\]]*\]\]", lambda m: "A" * len(m[0]), s)
    out, start = [], 0
    for m in _END.finditer(masked):
        mark = m.group()[0]
        if mark == "?" and not question_marks:
            continue
        if mark == ".":
            after = _NEXT.search(masked, m.end())
            after = after.group() if after else ""
            i = m.start()
            while i > start and not masked[i - 1].isspace():
                i -= 1
            word = masked[i : m.start()].lower().strip("(\"'")
            if word in HONORIFICS and after:
                continue
            if INITIALS.search(masked[max(start, i - 1) : m.start() + 1]) and after:
                continue
            if after.islower() or (after.isdigit() and word in ("no", "nr", "p")):
                continue
        if x := s[start : m.end()].strip():
            out.append(x)
        start = m.end()
    if x := s[start:].strip():
        out.append(x)
    return out


def first_sentence(s: str) -> str:
    """Sentences of the plain text up to more than 30 characters."""
    out = ""
    for x in sentences(first_paragraph(s) or strip_everything(s)):
        out += x
        if len(out) > 30:
            break
    return out


def first_paragraph(s: str) -> str:
    """The plain text up to the first blank line beyond 150 characters, else up to the last one; '' without any."""
    s = strip_indented_start(strip_everything(s))
    ends = [m.start() for m in re.finditer(r"\n[ \t]*\n", s + "\n\n")]
    for e in ends:
        if e > 150:
            return s[:e].strip()
    return s[: ends[-1]].strip() if ends else ""


def define(s: str, form: str = "html", whole: bool = False, base: str = "") -> str:
    """A definition: first sentence, or `whole` first paragraph, as 'plain', 'wiki' or 'html' text.

    In wiki form marks and links stay; in HTML they become tags, links to `base` + title.
    """
    keep = strip_indented_start(strip_to_links(s, marks=True)) if form != "plain" else strip_indented_start(strip_everything(s))
    text = keep.partition("\n\n")[0]
    if not whole:
        text = next(iter(sentences(text)), "")
    if form != "html":
        return text
    text = re.sub(r"'''(.+?)'''", r"<b>\1</b>", text)
    text = re.sub(r"''(.+?)''", r"<i>\1</i>", text)
    link = lambda x: f'<a href="{base}{x.partition("|")[0].strip().replace(" ", "_")}">{x.rpartition("|")[2]}</a>'
    return re.sub(r"\[\[|\]\]", "", balanced(text, "[[", "]]", link))


# --- same-length blanking, so that positions stay -------------------------------------------------------------------

def article_counts(s: str) -> tuple[int, int, int]:
    """(lines, list entries, words) of a text without templates, tables, links and tags; lines of over five characters count."""
    s = re.sub(r"</?[A-Za-z][^<>]*>", "", strip_links(strip_tables(strip_templates(s))))
    lines = [x for x in (re.sub("[:;]", " ", x).strip() for x in s.split("\n")) if len(x) > 5]
    return len(lines), sum(x[0] in "*#" for x in lines), len(re.findall(r"\w+", _formatting(s)))


#: Headings that say nothing about a document.
PLAIN_HEADINGS = ("see also", "references", "further reading", "external links")


def _blank(s: str) -> str:
    return re.sub(r"[^\n]", " ", s)


def preprocess_wiki(s: str) -> dict:
    """text (of the same length, markup blanked), context (link texts and headings), banned (destinations of links), splits (starts of sections), marks of regions (sections, tables)."""
    context: list[str] = []
    banned: list[str] = []
    splits = [m.start() for m in re.finditer(r"(?m)^=+[^=\n]+=+[ \t]*$", s)]
    for m in re.finditer(r"(?m)^=+([^=\n]+)=+[ \t]*$", s):
        if (h := m[1].strip()).lower() not in PLAIN_HEADINGS:
            context.append(h)

    marks = [(m.start(), "open" if m[0] == "{|" else "close") for m in re.finditer(r"\{\||\|\}", s)] + [(i, "split") for i in splits]

    def link(x: str) -> str:
        if not _prefix(x):
            banned.append(x.partition("|")[0].strip())
            context.append(x.rpartition("|")[2].strip())
        return "  " + _blank(x) + "  "

    for a, b, f in (("{{", "}}", None), ("{|", "|}", None), ("[[", "]]", link)):
        s = balanced(s, a, b, f or (lambda x: "  " + _blank(x) + "  "))
    s = between(s, _COMMENT, _COMMENT_END, _blank)
    s = between(re.sub(r"(?is)<ref\b[^<>]*/>", lambda m: _blank(m[0]), s), _REF, _REF_END, _blank)
    for rule in (r"</?[A-Za-z][^<>]*>", r"\[(?:https?|ftp)://[^\]]*\]", r"'{2,}", r"(?m)^=+[^=\n]+=+[ \t]*$", r"(?m)^[*#:;]+", r"&#?\w+;"):
        s = re.sub(rule, lambda m: _blank(m[0]), s)
    return {"text": s, "context": context, "banned": banned, "splits": splits, "marks": _marks(marks)}


def _marks(found: list[tuple[int, str]]) -> list[dict]:
    """Region marks in order, one a place."""
    return [{"start": a, "kind": k} for a, k in sorted(dict(reversed(found)).items())]


def preprocess_html(s: str) -> dict:
    """text (of the same length, markup and links blanked), context (title, keywords, description, link texts), banned (none), splits (starts of regions), marks of regions (div and table, split by headings)."""
    context: list[str] = []
    between(s, re.compile(r"(?i)<title\b[^<>]*>"), re.compile(r"(?i)</title"), lambda x: context.append(x[x.index(">") + 1 : -7].strip().lower()) or "")
    for m in re.finditer(r"(?is)<meta\b[^<>]*\bname\s*=\s*[\"'](?:keywords|description)[\"'][^<>]*\bcontent\s*=\s*[\"']([^\"']*)", s):
        context.append(m[1].strip().lower())
    between(s, _LINK_TAG, _LINK_END, lambda x: context.append(re.sub(r"<[^<>]*>", "", x).strip()) or "")
    splits = [m.start() for m in re.finditer(r"(?i)<(?:div|table|h1|h2)\b", s)]
    marks = [(m.start(), "close" if m[1] else "split" if m[2][0] in "hH" else "open") for m in re.finditer(r"(?i)<(?:(/)(?=div|table)|(?=div|table|h1|h2))(div|table|h1|h2)\b", s)]
    s = between(s, re.compile(r"(?i)<head\b"), re.compile(r"(?i)</head\s*>"), _blank)
    s = between(s, _COMMENT, _COMMENT_END, _blank)
    for t in ("script", "style"):
        s = between(s, re.compile(rf"(?i)<{t}\b"), re.compile(rf"(?i)</{t}\s*>"), _blank)
    s = between(s, _LINK_TAG, _LINK_END, _blank)
    for rule in (r"</?[A-Za-z][^<>]*>", r"&#?\w+;"):
        s = re.sub(rule, lambda m: _blank(m[0]), s)
    return {"text": s, "context": [c for c in context if c], "banned": [], "splits": splits, "marks": _marks(marks)}


def preprocess(s: str, mode: str) -> dict:
    """A text by its source mode: 'wiki', 'html' or anything else, which is plain."""
    if mode in ("wiki", "html"):
        return (preprocess_wiki if mode == "wiki" else preprocess_html)(s)
    return {"text": s, "context": [], "banned": [], "splits": [], "marks": []}


PREPROCESSED = "struct<text: string, context: array<string>, banned: array<string>, splits: array<int>, marks: array<struct<start: int, kind: string>>>"


def udf(f: Callable, kind: str = "string", *args: object) -> Callable[[Column], Column]:
    """A function of a text as a column function; null stays null."""

    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else f(x, *args))

    def run_rows(s: pd.Series) -> pd.DataFrame:
        none = {"text": None, "context": None, "banned": None, "splits": None, "marks": None}
        return pd.DataFrame([none if x is None else f(x) for x in s], columns=list(none))

    if kind.startswith("struct"):
        run_rows.__annotations__ = {"s": pd.Series, "return": pd.DataFrame}
        return lambda c: F.pandas_udf(run_rows, kind)(c)
    run.__annotations__ = {"s": pd.Series, "return": pd.Series}
    return lambda c: F.pandas_udf(run, kind)(c)
