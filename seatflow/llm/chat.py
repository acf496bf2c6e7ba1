"""Chat formatting by a finite-state machine over roles (native).

A ``Template`` declares the marks around each role's text, which roles carry
loss, and the machine: state = the last role, ``follows`` = the roles allowed
after it.  The state after a turn is the turn's own role, whatever came
before, so a stretch of turns is summed up by its first role, its last role
and whether every step inside is allowed; stretches join by one more step.
Long conversations are therefore built in chunks of ``chunk`` turns and the
chunks joined, instead of sorting all turns of one conversation in one row
group.

Inside texts every control string of the template is broken by a backslash
after its first character, and backslashes are doubled: no control string can
appear in a text, and ``unescape`` restores it exactly.

Defined cases: null text and null role count as empty; rows are ordered by
(turn, role, text), a null turn first, so repeated turns have one order; a
null conv_id is a conversation; an unknown role is marked with its own name in
the user's marks and makes the conversation invalid; invalid conversations are
formatted all the same and flagged.  Other columns are ignored.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seatflow.llm.common import stored, whole

CHUNK = 512


@dataclass(frozen=True)
class Template:
    """before/after: marks by role ("" for any other role)."""
    before: dict = field(default_factory=lambda: {"system": "<s><<SYS>>\n", "user": "<s>[INST] ",
                                                  "assistant": " ", "": "<s>[INST] "})
    after: dict = field(default_factory=lambda: {"system": "\n<</SYS>></s>", "user": " [/INST]",
                                                 "assistant": " </s>", "": " [/INST]"})
    controls: tuple = ("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
    loss: tuple = ("assistant",)
    follows: dict = field(default_factory=lambda: {"": ("system", "user"), "system": ("user",),
                                                   "user": ("assistant",), "assistant": ("user",)})
    final: tuple = ("assistant",)


LLAMA = Template()


def _heads(t: Template) -> str:
    """Pattern of a control string's first character, the rest ahead."""
    return "|".join(f"(?:{re.escape(c[0])}(?={re.escape(c[1:])}))" for c in t.controls)


def escape(text: Column, t: Template = LLAMA) -> Column:
    doubled = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    return F.regexp_replace(doubled, f"({_heads(t)})", "$1\\\\")


def unescape(text: Column, t: Template = LLAMA) -> Column:
    broken = "|".join(f"(?:{re.escape(c[0])}(?=\\\\{re.escape(c[1:])}))" for c in t.controls)
    return F.regexp_replace(text, rf"({broken})\\|\\(\\)", "$1$2")


def _by_role(role: Column, marks: dict) -> Column:
    out = F.lit(marks[""])
    for r, m in marks.items():
        if r:
            out = F.when(role == r, F.lit(m)).otherwise(out)
    return out


def _allowed(prev: Column, role: Column, t: Template) -> Column:
    out = F.lit(False)
    for state, nxt in t.follows.items():
        out = F.when(prev == state, role.isin(*nxt)).otherwise(out)
    return out


def format_conversations(turns: DataFrame, t: Template = LLAMA, chunk: int = CHUNK) -> DataFrame:
    """conv_id, valid, n_turns and ``segments``: array of (text, loss, role,
    turn end) whose texts in order are the formatted conversation."""
    rows = turns.select("conv_id", F.col("turn").cast("long").alias("turn"), whole(F.col("role")).alias("role"),
                        whole(F.col("text")).alias("text"))
    rows = rows.withColumn("chunk", F.coalesce(F.floor(F.col("turn") / chunk), F.lit(-(2**62))))
    parts = rows.groupBy("conv_id", "chunk").agg(
        F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    steps = F.transform(F.slice("turns", 2, F.greatest(F.lit(0), F.size("turns") - 1)),
                        lambda x, i: _allowed(F.col("turns")[i]["role"], x["role"], t))
    body = F.flatten(F.transform("turns", lambda x: F.array(
        F.struct(_by_role(x["role"], t.before).alias("text"), F.lit(False).alias("loss"), x["role"].alias("role"),
                 F.lit("mark").alias("kind")),
        F.struct(escape(x["text"], t).alias("text"), x["role"].isin(*t.loss).alias("loss"), x["role"].alias("role"),
                 F.lit("body").alias("kind")),
        F.struct(_by_role(x["role"], t.after).alias("text"), F.lit(False).alias("loss"), x["role"].alias("role"),
                 F.lit("mark").alias("kind")))))
    parts = parts.select(
        "conv_id", F.struct(
            "chunk", F.size("turns").cast("long").alias("n"), F.element_at("turns", 1)["role"].alias("first"),
            F.element_at("turns", -1)["role"].alias("last"), F.forall(steps, lambda ok: ok).alias("ok"),
            body.alias("segments")).alias("part"))
    joined = parts.groupBy("conv_id").agg(F.array_sort(F.collect_list("part")).alias("parts"))
    chain = F.transform("parts", lambda p, i: p["ok"] & _allowed(
        F.when(i == 0, F.lit("")).otherwise(F.col("parts")[F.greatest(i - 1, F.lit(0))]["last"]), p["first"], t))
    return joined.select(
        "conv_id", (F.forall(chain, lambda ok: ok) & F.element_at("parts", -1)["last"].isin(*t.final)).alias("valid"),
        F.aggregate("parts", F.lit(0).cast("long"), lambda n, p: n + p["n"]).alias("n_turns"),
        F.flatten(F.transform("parts", lambda p: p["segments"])).alias("segments"))


def digests(formatted: DataFrame, t: Template = LLAMA) -> DataFrame:
    """What the output says, read back from its segments alone."""
    bodies = F.filter("segments", lambda s: s["kind"] == "body")
    said = F.array_join(F.transform(bodies, lambda s: F.concat(s["role"], F.lit("\n"), unescape(s["text"], t),
                                                               F.lit("\n"))), "")
    lossy = F.array_join(F.transform(F.filter("segments", lambda s: s["loss"]),
                                     lambda s: unescape(s["text"], t)), "")
    chars = F.aggregate("segments", F.lit(0).cast("long"), lambda n, s: n + F.length(s["text"]))
    return formatted.withColumns({"said": said, "lossy": lossy}).select(
        "conv_id", F.size(bodies).cast("long").alias("n_turns"), F.sha2("said", 256).alias("turns_sha256"),
        F.length("lossy").cast("long").alias("loss_chars"), F.sha2("lossy", 256).alias("loss_sha256"),
        chars.alias("formatted_chars"), "valid")


def chat_report(turns: DataFrame, t: Template = LLAMA) -> DataFrame:
    """Write the formatted conversations to the shared folder, read them back
    and return their digests."""
    return digests(stored(format_conversations(turns, t), "chat"), t)
