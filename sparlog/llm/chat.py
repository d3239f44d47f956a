"""Relational chat formatting: conversations to training texts with a loss mask, and back, with Spark expressions only.

Turns are collected as structs and sorted, adjacent turns of one role become a
block by array functions, and blocks are joined to one text. Control strings
inside texts get one more backslash after their first character, which a
reader takes away again, so a text can hold any control string, escaped or not.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    """Marks of a chat template; every mark begins with ``<`` or ``[`` and holds neither again.

    ``blocks``: role, opening and closing mark. Other roles are written between
    ``role`` and ``role_end``, and their blocks end with ``end``. ``joint``
    stands between the turns of one block. ``learn`` is the role under the loss
    mask. ``foreign``: control strings of other templates, escaped as well.
    """

    begin: str = "<s>"
    blocks: tuple[tuple[str, str, str], ...] = (("user", "[INST]", "[/INST]"), ("assistant", "[OUT]", "</s>"))
    role: str = "[ROLE]"
    role_end: str = "[/ROLE]"
    end: str = "[END]"
    joint: str = "[AND]"
    learn: str = "assistant"
    foreign: tuple[str, ...] = ("[SYS]", "[/SYS]", "<|im_start|>", "<|im_end|>", "<|endoftext|>", "<pad>", "<unk>")

    def marks(self) -> list[str]:
        own = [self.begin, self.role, self.role_end, self.end, self.joint, *(m for b in self.blocks for m in b[1:])]
        found = list(dict.fromkeys([*own, *self.foreign]))
        if bad := [m for m in found if not re.fullmatch(r"[<\[][^<\[\\$]+", m)]:
            raise ValueError(f"marks must begin with < or [ and hold no further <, [, backslash or $: {bad}")
        if len({*own}) < len(own):
            raise ValueError("the marks of a template must differ")
        return found

    def _rests(self) -> str:
        return "|".join(_literal(m[1:]) for m in self.marks())

    def escape(self, text: Column) -> Column:
        return F.regexp_replace(text, rf"([<\[])(\\*)({self._rests()})", r"$1$2\\$3")

    def unescape(self, text: Column) -> Column:
        return F.regexp_replace(text, rf"([<\[])\\(\\*)({self._rests()})", r"$1$2$3")


def _literal(mark: str) -> str:
    return re.sub(r"([\]|/\\.^$*+?(){}\[\-])", r"\\\1", mark)


def _fixed(rows: DataFrame, **columns: Column) -> DataFrame:
    """``rows`` with further columns that are computed once, however often later expressions name them."""
    return rows.select("*", F.inline_outer(F.array(F.struct(*(c.alias(k) for k, c in columns.items())))))


def _chunked(lengths: Column) -> Column:
    """Chunks of the lengths, each with its total and the sums before its members: their number is their size, so that long arrays stay cheap."""
    size = F.greatest(F.ceil(F.sqrt(F.size(lengths))).cast("int"), F.lit(1))
    add = lambda a: F.aggregate(a, F.lit(0).cast("long"), lambda s, x: s + x)
    chunks = F.transform(F.sequence(F.lit(0), ((F.size(lengths) - 1) / size).cast("int")), lambda k: F.slice(lengths, k * size + 1, size))
    before = lambda chunk, k: F.transform(chunk, lambda _, i: add(F.slice(chunk, 1, i)))
    return F.struct(chunks.alias("chunks"), F.transform(chunks, before).alias("within"), F.transform(chunks, lambda c: add(c)).alias("totals"))


def format_chats(conversations: DataFrame, template: Template = Template()) -> DataFrame:
    """conv_id, formatted, loss: one training text for each conversation of (conv_id, turn, role, text).

    loss is an array of (start, end), code points of ``formatted``, end
    exclusive, one for each turn of the role that is learnt, in order; it
    covers the turn's escaped text and no mark.

    Turns are in order of turn (null first), then role and text; a null role
    or text counts as empty; turns with equal values stay each; rows without a
    conv_id make up a conversation of their own, with a null conv_id; an empty
    table gives no rows; other columns, whatever their names, are ignored. A
    conversation becomes one value of one row, so it must fit there (2 GB); no
    task holds more than one conversation's rows at a time besides its sort.
    """
    empty = F.lit("")
    rows = conversations.select(
        conversations["conv_id"].cast("long").alias("conv_id"),
        F.struct(conversations["turn"].cast("long").alias("turn"), F.coalesce(conversations["role"], empty).alias("role"), F.coalesce(conversations["text"], empty).alias("text")).alias("t"),
    )
    chats = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    chats = _fixed(chats, texts=F.transform("turns", lambda t: template.escape(t["text"])), firsts=F.filter(F.sequence(F.lit(0), F.size("turns") - 1), lambda i: (i == 0) | (F.col("turns")[i]["role"] != F.col("turns")[i - 1]["role"])))
    # a block: the role and the texts from its first turn up to the next block's
    block = lambda i, k: F.struct(F.col("turns")[i]["role"].alias("role"), F.slice("texts", i + 1, F.coalesce(F.get(F.col("firsts"), k + 1), F.size("turns")) - i).alias("texts"))
    chats = _fixed(chats.select("conv_id", "turns", "texts", "firsts"), blocks=F.transform("firsts", block)).select("conv_id", "blocks")

    def mark(role: Column, which: int) -> Column:
        out = F.concat(F.lit(template.role), template.escape(role), F.lit(template.role_end)) if which == 1 else F.lit(template.end)
        for b in reversed(template.blocks):
            out = F.when(role == b[0], F.lit(b[which])).otherwise(out)
        return out

    opened = F.transform("blocks", lambda b: F.struct(mark(b["role"], 1).alias("open"), mark(b["role"], 2).alias("close"), (b["role"] == template.learn).alias("learn"), b["texts"].alias("texts")))
    chats = _fixed(chats, parts=opened).select("conv_id", "parts")
    written = F.transform("parts", lambda p: F.concat(p["open"], F.array_join(p["texts"], template.joint), p["close"]))
    # what lies before each turn's text: its block's opening mark or the joint, and after a block's last turn its closing mark
    n, joint = F.size, F.lit(len(template.joint))
    pieces = F.flatten(F.transform("parts", lambda p: F.transform(p["texts"], lambda t, i: F.struct(F.when(i == 0, F.length(p["open"])).otherwise(joint).cast("long").alias("lead"), F.length(t).cast("long").alias("own"), F.when(i == n(p["texts"]) - 1, F.length(p["close"])).otherwise(0).cast("long").alias("tail"), p["learn"].alias("learn")))))
    chats = _fixed(chats, formatted=F.concat(F.lit(template.begin), F.array_join(written, "")), pieces=pieces).select("conv_id", "formatted", "pieces")
    chats = _fixed(chats, sums=_chunked(F.transform("pieces", lambda p: p["lead"] + p["own"] + p["tail"])))
    bases = F.transform("sums.totals", lambda _, k: F.aggregate(F.slice("sums.totals", 1, k), F.lit(len(template.begin)).cast("long"), lambda s, x: s + x))
    chats = _fixed(chats, bases=bases)
    starts = F.flatten(F.transform("sums.within", lambda w, k: F.transform(w, lambda x: x + F.col("bases")[k])))
    spans = F.zip_with("pieces", starts, lambda p, s: F.struct((s + p["lead"]).alias("start"), (s + p["lead"] + p["own"]).alias("end"), p["learn"].alias("learn")))
    loss = F.transform(F.filter(spans, lambda s: s["learn"]), lambda s: F.struct(s["start"], s["end"]))
    return chats.select("conv_id", "formatted", loss.alias("loss"))


def read_chats(formatted: DataFrame, template: Template = Template()) -> DataFrame:
    """conv_id, turns (array of role, text), learnt (array of texts) and formatted, read back from (conv_id, formatted, loss)."""
    ends = "|".join(_literal(m) for m in (template.end, *(b[2] for b in template.blocks)))
    body = F.substring(F.col("formatted"), F.lit(len(template.begin) + 1), F.length("formatted"))
    chats = _fixed(formatted.select("conv_id", "formatted", "loss"), parts=F.split(body, ends))
    chats = _fixed(chats, blocks=F.slice("parts", 1, F.size("parts") - 1)).select("conv_id", "formatted", "loss", "blocks")

    def read(block: Column) -> Column:
        other = F.substring(block, F.lit(len(template.role) + 1), F.length(block))
        role = F.substring_index(other, template.role_end, 1)
        out = F.struct(template.unescape(role).alias("role"), F.substring(other, F.length(role) + len(template.role_end) + 1, F.length(block)).alias("body"))
        for name, start, _ in reversed(template.blocks):
            out = F.when(F.startswith(block, F.lit(start)), F.struct(F.lit(name).alias("role"), F.substring(block, F.lit(len(start) + 1), F.length(block)).alias("body"))).otherwise(out)
        return out

    chats = _fixed(chats, read=F.transform("blocks", read)).select("conv_id", "formatted", "loss", "read")
    turns = F.flatten(F.transform("read", lambda b: F.transform(F.split(b["body"], _literal(template.joint)), lambda t: F.struct(b["role"], template.unescape(t).alias("text")))))
    learnt = F.transform("loss", lambda s: template.unescape(F.substring(F.col("formatted"), (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int"))))
    return chats.select("conv_id", "formatted", turns.alias("turns"), learnt.alias("learnt"))
