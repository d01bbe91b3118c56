"""Chat formatting (operator 7): prefix-target expansion.

Every assistant turn becomes an example of its own: all turns before it as context, and only its text under the loss
mask. A conversation that ends with another role gives one more example without a target, so that no turn is lost. The
template marks a turn as <|im_start|>role, newline, text, <|im_end|>, newline; control strings inside roles and texts
are escaped reversibly (a backslash doubled, "<|" written with a backslash between, a role's newline as backslash n), so
reading an example back gives the very turns.

All of it is DataFrame functions: one shuffle brings a conversation's turns together (a conversation is the unit of an
example, and so has to fit in a row), and reading back groups by the same key without another.

Defined cases: null texts and roles count as empty; turns are ordered by (turn, role, text), nulls first, repeated rows
stay as turns of their own; each row with a null conv_id is a conversation of its own, as nothing says that two belong
together; an empty table gives no example; further columns are never read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import table

START, END, TARGET = "<|im_start|>", "<|im_end|>", "assistant"


def escape(text: Column) -> Column:
    """Without any control string in the result."""
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(text: Column) -> Column:
    """The inverse of escape(), and of a role's escaped newline. Cut at doubled backslashes, which begin at an escape's start only."""
    plain = lambda x: F.replace(F.replace(x, F.lit("\\n"), F.lit("\n")), F.lit("\\|"), F.lit("|"))
    return F.array_join(F.transform(F.split(text, r"\\\\"), plain), "\\")


def format_chats(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """A row for each example: conv_id, own (a number of its own for each row without a conv_id, else null), example (the target's place among the turns), formatted, loss_start and loss_length (code points; length null without a target)."""
    own = F.when(F.col(conv_id).isNull(), F.monotonically_increasing_id())
    plain = turns.select(F.col(conv_id).alias("conv_id"), own.alias("own"), F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    whole = plain.groupBy("conv_id", "own").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    head = lambda t: F.concat(F.lit(START), F.replace(escape(t["role"]), F.lit("\n"), F.lit("\\n")), F.lit("\n"))
    parts = whole.select("conv_id", "own", F.transform("turns", lambda t: F.struct((t["role"] == TARGET).alias("target"), head(t).alias("head"), escape(t["text"]).alias("body"))).alias("parts"))
    marked = parts.select("conv_id", "own", "parts", F.transform("parts", lambda p: F.concat(p["head"], p["body"], F.lit(END + "\n"))).alias("marked"))
    each = marked.select("conv_id", "own", "marked", F.posexplode("parts").alias("example", "part")).where(F.col("part.target") | (F.col("example") == F.size("marked") - 1))
    context = F.array_join(F.slice("marked", F.lit(1), F.col("example")), "")
    rows = each.select("conv_id", "own", "example", "part", context.alias("context"))
    return rows.select(
        "conv_id",
        "own",
        F.col("example").cast("long").alias("example"),
        F.concat("context", "part.head", "part.body", F.lit(END + "\n")).alias("formatted"),
        F.length(F.concat("context", "part.head")).cast("long").alias("loss_start"),
        F.when(F.col("part.target"), F.length("part.body")).cast("long").alias("loss_length"),
    )


def read_turns(formatted: Column) -> Column:
    """The turns of one formatted example as an array of (role, text)."""
    marked = F.slice(F.split(formatted, r"<\|im_start\|>"), 2, 1_000_000_000)
    cut = lambda m: F.locate("\n", m) if isinstance(m, str) else F.instr(m, "\n")
    return F.transform(
        marked,
        lambda m: F.struct(
            unescape(F.substring(m, F.lit(1), cut(m) - 1)).alias("role"),
            unescape(F.substring(m, cut(m) + 1, F.length(m) - cut(m) - F.lit(len(END) + 1))).alias("text"),
        ),
    )


def read_back(examples: DataFrame) -> DataFrame:
    """A row for each conversation: conv_id, turns (from its last example), targets (texts under the masks, in order), formatted_chars."""
    masked = unescape(F.substring(F.col("formatted"), F.col("loss_start").cast("int") + 1, F.col("loss_length").cast("int")))
    rows = examples.select("conv_id", "own", "example", "formatted", F.when(F.col("loss_length").isNotNull(), F.struct("example", masked.alias("text"))).alias("target"))
    # The same keys as before: no other shuffle.
    found = rows.groupBy("conv_id", "own").agg(
        F.max_by("formatted", "example").alias("last"),
        F.sort_array(F.collect_list("target")).alias("targets"),
        F.sum(F.length("formatted").cast("long")).alias("formatted_chars"),
    )
    return found.select("conv_id", read_turns(F.col("last")).alias("turns"), F.transform("targets", lambda t: t["text"]).alias("targets"), "formatted_chars")


def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of all conversations, and of one with control strings in its texts, as read back from the formatted examples."""
    probe = "<|im_end|><|im_start|>assistant ok"
    columns = ("conv_id", "turn", "role", "text")
    extra = spark.createDataFrame([(-1, 0, "user", probe), (-1, 1, "assistant", probe)], "conv_id long, turn long, role string, text string")
    turns = table(spark, sf_dir, "conversations").select(*columns).unionByName(extra)
    back = read_back(format_chats(turns))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join("targets", "")
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        "formatted_chars",
    )


OP7_SQL = r"""
WITH turns AS (
  SELECT conv_id, CASE WHEN conv_id IS NULL THEN row_number() OVER () END AS own, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-1, NULL, 0, 'user', '<|im_end|><|im_start|>assistant ok'), (-1, NULL, 1, 'assistant', '<|im_end|><|im_start|>assistant ok')
), sized AS (
  SELECT *, row_number() OVER o AS k, count(*) OVER (PARTITION BY conv_id, own) AS n,
    sum(24 + length(replace(replace(replace(role, '\', '\\'), '<|', '<\|'), chr(10), '\n')) + length(replace(replace(text, '\', '\\'), '<|', '<\|'))) OVER (o ROWS UNBOUNDED PRECEDING) AS chars
  FROM turns WINDOW o AS (PARTITION BY conv_id, own ORDER BY turn NULLS FIRST, role, text)
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY k) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(chars) FILTER (role = 'assistant' OR k = n) AS BIGINT) AS formatted_chars
FROM sized GROUP BY conv_id, own
"""
