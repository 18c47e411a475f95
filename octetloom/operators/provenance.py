"""Where values come from: trees of named parts, their ancestors, and reports."""

from __future__ import annotations

import textwrap
import unicodedata
from dataclasses import dataclass, field

import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from octetloom.errors import MESSAGES, Context, DecodeError
from octetloom.schemas import PATH
from octetloom.session import checkpointed

_STEP = PATH[6:-1]


def child(path: Column | None, name: Column | str, offset: Column | None = None, size: Column | None = None) -> Column:
    """A path with one more part: physical with an offset in its parent, else logical."""
    name = F.lit(name) if isinstance(name, str) else name
    none = F.lit(None).cast("bigint")
    step = F.struct(name.alias("name"), F.lit("logical" if offset is None else "physical").alias("kind"), (none if offset is None else offset.cast("bigint")).alias("offset"), (none if size is None else size.cast("bigint")).alias("size")).cast(_STEP)
    return F.array(step) if path is None else F.concat(path, F.array(step))


def index_name(i: Column) -> Column:
    """The name of a numbered part."""
    return F.concat(F.lit("["), i.cast("string"), F.lit("]"))


def clipped_name(name: Column, most: int) -> Column:
    """A name of at most ``most`` characters, an ellipsis where it was cut."""
    return F.when(F.char_length(name) > most, F.concat(F.left(name, F.lit(most - 1)), F.lit("…"))).otherwise(name)


def absolute_offset(path: Column) -> Column:
    """The sum of the physical offsets along a path."""
    return F.aggregate(path, F.lit(0).cast("bigint"), lambda s, p: s + F.coalesce(p["offset"], F.lit(0)))


def _known(nodes: DataFrame) -> DataFrame:
    """(id, parent) of the nodes whose parent is a node."""
    nodes = nodes.select("id", "parent")
    return nodes.where("parent IS NOT NULL").join(nodes.select(F.col("id").alias("parent")).distinct(), "parent", "left_semi").select("id", "parent")


def _too_far(reach: int, n: int) -> None:
    if reach > n:
        raise ValueError("the nodes have a cycle")


def ancestors(nodes: DataFrame) -> DataFrame:
    """(id, ancestor, distance) for every node of (id, parent), itself at distance 0; a parent that is not a node ends the walk.

    Each round joins what is known up to a reach with what is that reach further
    up, so that a walk of any depth takes as many rounds as the log of its depth.
    A cycle is an error.
    """
    out = nodes.select("id", F.col("id").alias("ancestor"), F.lit(0).alias("distance"))
    up, reach, n = checkpointed(_known(nodes)), 1, nodes.count()
    out = checkpointed(out)
    while not up.isEmpty():
        _too_far(reach, n)
        above = out.select(F.col("id").alias("parent"), "ancestor", (F.col("distance") + reach).alias("distance"))
        out = checkpointed(out.unionByName(up.join(above, "parent").select("id", "ancestor", "distance")))
        up = checkpointed(up.join(up.select(F.col("id").alias("parent"), F.col("parent").alias("further")), "parent").select("id", F.col("further").alias("parent")))
        reach *= 2
    return out


def lineage(nodes: DataFrame) -> DataFrame:
    """(id, root, depth, family_exists) for every node of (id, parent): the top of its walk, how far up that is, and whether it is there because it has no parent, not because its parent is no node.

    Walks double as in ancestors(), but only their tops are kept. A cycle is an error.
    """
    n, reach = nodes.count(), 1
    up = nodes.select("id", F.col("parent").alias("own")).join(_known(nodes), "id", "left")
    up = checkpointed(up.select("id", F.coalesce("parent", "id").alias("at"), F.when(F.col("parent").isNotNull(), 1).otherwise(0).cast("bigint").alias("depth"), (F.col("own").isNotNull() & F.col("parent").isNull()).alias("broken")))
    while True:
        above = up.select(F.col("id").alias("at"), F.col("at").alias("further"), F.col("depth").alias("more"), F.col("broken").alias("broken_above"))
        new = up.join(above, "at").select("id", F.col("further").alias("at"), (F.col("depth") + F.col("more")).alias("depth"), (F.col("broken") | F.col("broken_above")).alias("broken"), (F.col("more") > 0).alias("moved"))
        new = checkpointed(new)
        up = new.drop("moved")
        if new.where("moved").isEmpty():
            return up.select("id", F.col("at").alias("root"), "depth", (~F.col("broken")).alias("family_exists"))
        reach *= 2
        _too_far(reach, 2 * n)


def parents(nodes: DataFrame) -> DataFrame:
    """(id, parent, exists) for every node that names a parent, and whether that is a node."""
    named = nodes.where("parent IS NOT NULL").select("id", "parent")
    ids = nodes.select(F.col("id").alias("parent"), F.lit(True).alias("__there")).distinct()
    return named.join(ids, "parent", "left").select("id", "parent", F.coalesce("__there", F.lit(False)).alias("exists"))


def graphemes(text: str) -> list[str]:
    """What a reader sees as characters."""
    return regex.findall(r"\X", text)


def display_width(text: str) -> int:
    """Terminal cells of a text: two for wide characters, none for marks and controls."""
    cells = 0
    for g in graphemes(text):
        c = g[0]
        if unicodedata.category(c) not in ("Cc", "Cf", "Mn", "Me"):
            cells += 2 if unicodedata.east_asian_width(c) in "WF" or "\ufe0f" in g else 1
    return cells


def clipped(text: str, width: int) -> str:
    """A text cut between graphemes to ``width`` cells, an ellipsis in place of what is gone."""
    if display_width(text) <= width:
        return text
    out, cells = "", 0
    for g in graphemes(text):
        cells += display_width(g)
        if cells > width - 1:
            break
        out += g
    return out + "…"


@dataclass
class Report:
    """A problem for people: title, kind, lines of information, flags and notes on places."""

    title: str
    kind: str = ""
    info: list[str] = field(default_factory=list)
    flags: list[str] = field(default_factory=list)
    notes: list[tuple[str, tuple]] = field(default_factory=list)

    @classmethod
    def of(cls, e: DecodeError, context: Context | None = None) -> Report:
        info = [f"{k} {v}" for k, v in (("offset", e.offset), ("length", e.length), ("container length", e.stream_length)) if v is not None]
        context = context or e.context
        flags = ["some diagnostics failed to load"] if context and context.any_missing() else []
        return cls(MESSAGES[e.code], e.code, info + ([x for x in context.lines() if x not in flags] if context else []), flags, [(e.component, e.path)])

    def render(self, width: int = 80, style: str = "plain") -> str:
        """Text of at most ``width`` columns, as plain text, ANSI or HTML."""
        mark = {"plain": ("", ""), "ansi": ("\x1b[1m", "\x1b[0m"), "html": ("<b>", "</b>")}[style]
        safe = (lambda s: s.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;")) if style == "html" else (lambda s: s)
        lines = [f"{mark[0]}{safe(x)}{mark[1]}" for x in textwrap.wrap(f"{self.kind}: {self.title}" if self.kind else self.title, width)]
        for sign, items in (("-", self.info), ("!", self.flags)):
            for item in items:
                lines += map(safe, textwrap.wrap(item, width, initial_indent=f"  {sign} ", subsequent_indent="    "))
        tree: dict = {}
        for text, path in self.notes:
            at = tree
            for part in path:
                at = at.setdefault(part, {})
            at.setdefault(None, []).append(text)
        lines += [f"  {safe(x)}" for x in _drawn(tree, width - 2)]
        return "\n".join(lines)


def _drawn(tree: dict, width: int) -> list[str]:
    """The parts of a merged tree, by place, as lines: branches to the parts below, the part's extent underlined where something is said of it, and arrows from there to what is said."""
    out: list[str] = []
    parts = sorted((p for p in tree if p is not None), key=lambda p: (p[2] is None, p[2] or 0, p[0]))
    for i, part in enumerate(parts):
        name, _, offset, size = part
        below, notes = tree[part], tree[part].get(None, [])
        more = i + 1 < len(parts)
        label = f"{name}{'' if offset is None else f' @{offset}'}{'' if size is None else f' ({size} bytes)'}"
        out.append(clipped(f"{'├─' if more else '└─'} {label}", width))
        stem = "│  " if more else "   "
        inner = any(p is not None for p in below)
        if notes:
            out.append(clipped(f"{stem}{'│' if inner else ' '}{'~' * max(1, display_width(name) - 1)}", width))
        for k, note in enumerate(notes):
            arrow = "├──▶ " if k + 1 < len(notes) else "╰──▶ "
            wrapped = textwrap.wrap(note, max(8, width - len(stem) - 6)) or [""]
            out.append(clipped(f"{stem}{'│' if inner else ' '}{arrow}{wrapped[0]}", width))
            bar = "│" if k + 1 < len(notes) else " "
            out += [clipped(f"{stem}{'│' if inner else ' '}{bar}    {w}", width) for w in wrapped[1:]]
        out += [f"{stem}{x}" for x in _drawn(below, width - 3)]
    return out


#: Sample reports by name, for looking at.
GALLERY: dict[str, Report] = {}


def story(name: str):
    """Registers what a function returns as a sample report."""

    def add(make):
        GALLERY[name] = make()
        return make

    return add


@story("truncated file")
def _truncated() -> Report:
    return Report.of(DecodeError("truncated", "yaz0.blocks", 20, 50, 11, (("file", "physical", 0, 99), ("blocks", "physical", 16, 83))), Context().note("operation", "copy").note("block", None))


@story("unknown tag")
def _unknown_tag() -> Report:
    return Report.of(DecodeError("unknown_tag", "tag 0x13", 20, None, 64, (("file", "physical", 0, 64), ("key_table", "physical", 16, 48))))


def unwrapped(call, *args, width: int = 80):
    """The value of a call; a decode error becomes a RuntimeError whose message is its report."""
    try:
        return call(*args)
    except DecodeError as e:
        raise RuntimeError(Report.of(e).render(width)) from e


def rendered(reports: dict[str, Report], width: int = 80, style: str = "plain") -> list[tuple[str, int, str]]:
    """(name, number, line) of every line of some reports."""
    return [(name, i, line) for name, r in reports.items() for i, line in enumerate(r.render(width, style).split("\n"))]
