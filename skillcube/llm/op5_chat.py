"""Chat formatting with a grammar round trip, in DataFrame functions only.

A conversation is the concatenation of its turns, in order of (turn, role, text):

    <s>[INST] role [/INST] text</s>

The grammar has no control string (<s>, </s>, [INST], [/INST]) within a role or a text: the parser takes a turn
that holds one for no turn. Each text is rendered at the lowest escape level at which the parser gives
the turn back unchanged: 0 as it is (no control strings, no entities), 1 with control strings and `&`
escaped, 2 with every `&`, `<` and `[` escaped; roles are always at level 2. One parser reads all levels,
since it undoes entities everywhere. The joined turns are parsed once more and compared with their
source; where they differ all texts go to level 2, which leaves no character that a control string starts with.

Null texts and roles are empty, null turns come first, turns with one number are in order of role and
text, repeated turns stay; a null conv_id is a conversation of its own. Extra columns are left aside. An empty table
gives no rows. Long conversations are rendered in chunks of turns, so that only the finished strings
of a conversation meet in one row; very long texts are cut and escaped like others. The loss mask is cut from four bytes a code point, so
a conversation may have some 500 million characters. Every code point comes back, a byte order mark (U+FEFF) at the start of a text too.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import table

OPEN, ROLE_END, CLOSE = "<s>[INST] ", " [/INST] ", "</s>"
CONTROLS = ("<s>", "</s>", "[INST]", "[/INST]")
ENTITIES = (("&", "&amp;"), ("<", "&lt;"), ("[", "&#91;"))
TURNS_PER_CHUNK = 1024
LOSS_ROLE = "assistant"


def escape_all(text: Column) -> Column:
    for plain, entity in ENTITIES:
        text = F.replace(text, F.lit(plain), F.lit(entity))
    return text


def escape_controls(text: Column) -> Column:
    text = F.replace(text, F.lit("&"), F.lit("&amp;"))
    for c in CONTROLS:
        text = F.replace(text, F.lit(c), F.lit(dict(ENTITIES)[c[0]] + c[1:]))
    return text


def unescape(text: Column) -> Column:
    for plain, entity in reversed(ENTITIES):
        text = F.replace(text, F.lit(entity), F.lit(plain))
    return text


def render(role: Column, escaped: Column) -> Column:
    return F.concat(F.lit(OPEN), escape_all(role), F.lit(ROLE_END), escaped, F.lit(CLOSE))


def parse(formatted: Column) -> Column:
    """array<struct<role, text>>; a segment outside the grammar, as one with a control string inside, gives a null element."""
    parts = F.split(formatted, CLOSE, -1)

    def turn(s: Column) -> Column:
        body = F.substr(s, F.lit(len(OPEN) + 1))
        at = F.instr(body, ROLE_END)
        text = F.substr(body, at + len(ROLE_END))
        clean = ~(body.contains("<s>") | body.contains("[INST]") | text.contains("[/INST]"))
        return F.when(s.startswith(OPEN) & (at > 0) & clean, F.struct(unescape(F.substr(body, F.lit(1), at - 1)).alias("role"), unescape(text).alias("text")))

    return F.transform(F.slice(parts, 1, F.size(parts) - 1), turn)


def _same(parsed: Column, source: Column) -> Column:
    return F.coalesce(parsed == source, F.lit(False))


def render_turn(role: Column, text: Column) -> Column:
    source = F.array(F.struct(role.alias("role"), text.alias("text")))
    r0, r1 = render(role, text), render(role, escape_controls(text))
    return F.when(_same(parse(r0), source), r0).when(_same(parse(r1), source), r1).otherwise(render(role, escape_all(text)))


def format_conversations(conversations: DataFrame, turns_per_chunk: int = TURNS_PER_CHUNK) -> DataFrame:
    """conv_id, formatted, loss_spans: array<struct<start, length>> of code points in formatted (from 0)."""
    at = F.coalesce(F.col("turn").cast("long"), F.lit(-(2**63)))
    rows = conversations.select(
        "conv_id",
        F.floor(at / turns_per_chunk).cast("long").alias("chunk"),
        F.struct(at.alias("at"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).alias("t"),
    )
    chunks = rows.groupBy("conv_id", "chunk").agg(F.transform(F.array_sort(F.collect_list("t")), lambda t: F.struct(t.role.alias("role"), t.text.alias("text"))).alias("source"))
    joined = F.array_join(F.transform("source", lambda t: render_turn(t.role, t.text)), "")
    safest = F.array_join(F.transform("source", lambda t: render(t.role, escape_all(t.text))), "")
    chunks = chunks.withColumn("formatted", joined).withColumn("formatted", F.when(_same(parse(F.col("formatted")), F.col("source")), F.col("formatted")).otherwise(safest))
    chunks = chunks.select("conv_id", "chunk", "formatted", F.char_length("formatted").alias("chars"), _spans(F.col("formatted")).alias("spans"))
    whole = chunks.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("chunk", "formatted", "chars", "spans"))).alias("c"))
    shifted = F.aggregate(
        "c",
        F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:bigint,length:bigint>>").alias("spans")),
        lambda acc, c: F.struct((acc.at + c.chars).alias("at"), F.concat(acc.spans, F.transform(c.spans, lambda s: F.struct((s.start + acc.at).alias("start"), s.length.alias("length")))).alias("spans")),
        lambda acc: acc.spans,
    )
    return whole.select("conv_id", F.array_join(F.transform("c", lambda c: c.formatted), "").alias("formatted"), shifted.alias("loss_spans"))


def _spans(formatted: Column) -> Column:
    """Places of the loss role's texts, as they stand (escaped), in a formatted string."""
    parts = F.split(formatted, CLOSE, -1)

    def step(acc, s):
        body = F.instr(s, ROLE_END) + len(ROLE_END) - 1  # code points before the text
        role = F.substr(s, F.lit(len(OPEN) + 1), body - len(ROLE_END) - len(OPEN))
        n = F.char_length(s).cast("long")
        span = F.array(F.struct((acc.at + body).cast("long").alias("start"), (n - body).cast("long").alias("length")))
        return F.struct((acc.at + n + len(CLOSE)).alias("at"), F.when(role == escape_all(F.lit(LOSS_ROLE)), F.concat(acc.spans, span)).otherwise(acc.spans).alias("spans"))

    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:bigint,length:bigint>>").alias("spans"))
    return F.aggregate(F.slice(parts, 1, F.size(parts) - 1), start, step, lambda acc: acc.spans)


def masked(formatted: Column, spans: Column) -> Column:
    """The text under the spans, unescaped, end to end. In four bytes a code point a cut costs what it cuts.

    The decoder takes one mark at the start for the byte order's, so each cut gets one: any other is text.
    """
    mark = F.unhex(F.lit("0000FEFF"))

    def cut(raw):
        return F.array_join(F.transform(spans, lambda s: unescape(F.decode(F.concat(mark, F.substr(raw, (s.start * 4 + 1).cast("int"), (s.length * 4).cast("int"))), "UTF-32"))), "")

    return F.element_at(F.transform(F.array(F.encode(formatted, "UTF-32")), cut), 1)  # one element: encoded once


def digests(formatted: DataFrame) -> DataFrame:
    """What the formatted strings and their loss masks say when read back."""
    turns = formatted.select("conv_id", "formatted", parse(F.col("formatted")).alias("turns"), masked(F.col("formatted"), F.col("loss_spans")).alias("loss"))
    return turns.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t.role, F.lit("\n"), t.text, F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.char_length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )


PROBE = [(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")]


def query(spark, sf_dir):
    probe = spark.createDataFrame(PROBE, "conv_id long, turn long, role string, text string")
    conversations = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(probe)
    return digests(format_conversations(conversations))


SQL = """
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), levels AS (
  SELECT *, replace(replace(replace(role, '&', '&amp;'), '<', '&lt;'), '[', '&#91;') AS role2,
    replace(replace(replace(text, '&#91;', '['), '&lt;', '<'), '&amp;', '&') = text AND NOT (contains(text, '<s>') OR contains(text, '</s>') OR contains(text, '[INST]') OR contains(text, '[/INST]')) AS plain,
    replace(replace(replace(replace(replace(text, '&', '&amp;'), '<s>', '&lt;s>'), '</s>', '&lt;/s>'), '[INST]', '&#91;INST]'), '[/INST]', '&#91;/INST]') AS text1
  FROM rows
), shown AS (
  SELECT *, 23 + length(role2) + length(CASE WHEN plain THEN text ELSE text1 END) AS chars FROM levels
)
SELECT conv_id, CAST(count(*) AS BIGINT) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(chars) AS BIGINT) AS formatted_chars
FROM shown GROUP BY conv_id
"""
