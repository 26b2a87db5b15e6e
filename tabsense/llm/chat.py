r"""Chat formatting checked by a grammar round trip (DataFrame functions only).

    conversation := turn*      turn := START role "\n" text END "\n"

``START`` and ``END`` may stand nowhere else.  Every turn is rendered as it is, parsed
again and compared with its source; where that differs, more of its content is escaped
until both are identical: first the text (a backslash goes into everything that looks
like a control string, escaped ones too, so taking one backslash out gives the source
back), then the role (percent codes).  The turns of a conversation are joined in order,
the whole is parsed once more and compared turn by turn.

One shuffle: rendered turns by conversation.  Offsets are running sums in that same
partitioning.  Escaping and the first round trip run before it, on single rows; only
one conversation's own text has to fit in a value (2 GB in Spark), as its output is one
text.

Defined results: null role or text counts as empty; invalid UTF-8 becomes U+FFFD; turns
go by turn (null last), then role, then text, so repeated turns all stay; rows with a
null conversation id are one conversation; the loss mask covers the text of turns whose
role is exactly ``assistant``, an empty one too; an empty table gives no rows; other
columns, whatever their names, are ignored.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabsense.llm.common import bind

# The control strings of the template.
START, END = "<|im_start|>", "<|im_end|>"
CONTROL = r"<\|im_(?:start|end)\|>"
LOOKS_LIKE = r"<\|(\\*)(im_start|im_end)\|>"
ESCAPED = r"<\|\\(\\*)(im_start|im_end)\|>"
TRAINED_ROLE = "assistant"
#: Codes of a role's own control characters; "%" goes first and comes back last.
ROLE_CODES = [("%", "%25"), ("\n", "%0A"), ("|", "%7C")]


def escape_text(text: Column) -> Column:
    return F.regexp_replace(text, LOOKS_LIKE, r"<|$1\\$2|>")


def unescape_text(text: Column) -> Column:
    return F.regexp_replace(text, ESCAPED, r"<|$1$2|>")


def escape_role(role: Column) -> Column:
    for plain, code in ROLE_CODES:
        role = F.replace(role, F.lit(plain), F.lit(code))
    return role


def unescape_role(role: Column) -> Column:
    for plain, code in reversed(ROLE_CODES):
        role = F.replace(role, F.lit(code), F.lit(plain))
    return role


def render(role: Column, text: Column) -> Column:
    return F.concat(F.lit(START), role, F.lit("\n"), text, F.lit(END + "\n"))


def bodies(formatted: Column) -> Column:
    """What stands between each START and its END; null if ``formatted`` is no conversation."""
    def odd(pieces: Column) -> Column:
        between = F.filter(pieces, lambda x, i: (i > 0) & (i % 2 == 0))
        fits = (F.size(pieces) % 2 == 1) & (F.get(pieces, F.lit(0)) == "") & F.forall(between, lambda x: x == "\n")
        return F.when(fits, F.filter(pieces, lambda x, i: i % 2 == 1))

    return bind(F.split(formatted, CONTROL, -1), odd)


def parse(formatted: Column) -> Column:
    """array<struct<role, text>> of a formatted conversation; null if it is none."""
    def turn(body: Column) -> Column:
        head = F.substring_index(body, "\n", 1)
        return F.struct(unescape_role(head).alias("role"),
                        unescape_text(F.substr(body, F.length(head) + 2)).alias("text"))

    return F.transform(bodies(formatted), turn)


def rendered(role: Column, text: Column) -> Column:
    """struct<role, text> as they stand in the output: escaped until the round trip is exact."""
    source = F.array(F.struct(role.alias("role"), text.alias("text")))
    tries = [(role, text), (role, escape_text(text)), (escape_role(role), escape_text(text))]
    levels = [F.when(parse(render(r, t)).eqNullSafe(source), F.struct(r.alias("role"), t.alias("text"))) for r, t in tries]
    return F.coalesce(*levels, F.raise_error(F.lit("a turn does not survive the round trip")).cast("struct<role:string,text:string>"))


def format_conversations(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn",
                         role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conversation, formatted, turn_starts, loss_spans, round_trip): ``turn_starts`` has a
    code point offset a turn, ``loss_spans`` (start, end) a trained turn and null otherwise,
    both in ``formatted``; ``round_trip`` tells that parsing gives every turn back."""
    def clean(name: str) -> Column:
        return F.make_valid_utf8(F.coalesce(F.col(f"`{name}`").cast("string"), F.lit("")))

    turns = (df.select(F.col(f"`{conv_col}`").alias("conv"), F.col(f"`{turn_col}`").alias("turn"),
                       clean(role_col).alias("role"), clean(text_col).alias("text"))
             .withColumn("out", rendered(F.col("role"), F.col("text")))
             .select("conv", "turn", "role", "text", render(F.col("out.role"), F.col("out.text")).alias("chunk"),
                     F.length("out.role").alias("head"), F.length("out.text").alias("long")))
    order = Window.partitionBy("conv").orderBy(F.col("turn").asc_nulls_last(), "role", "text")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    first = F.col("start") + F.lit(len(START) + 1) + F.col("head")
    placed = (turns.withColumns({"at": F.row_number().over(order),
                                 "start": F.coalesce(F.sum(F.length("chunk").cast("long")).over(before), F.lit(0).cast("long"))})
              .select("conv", F.struct("at", "chunk", "start", F.xxhash64("role", "text").alias("source"),
                                       F.when(F.col("role") == TRAINED_ROLE,
                                              F.struct(first.alias("start"), (first + F.col("long")).alias("end"))).alias("loss"))
                      .alias("t")))
    joined = (placed.groupBy("conv").agg(F.array_sort(F.collect_list("t")).alias("t"))
              .select(F.col("conv").alias(conv_col), F.array_join("t.chunk", "").alias("formatted"),
                      F.col("t.start").alias("turn_starts"), F.col("t.loss").alias("loss_spans"),
                      F.col("t.source").alias("_source")))
    again = F.transform(parse(F.col("formatted")), lambda t: F.xxhash64(t["role"], t["text"]))
    return joined.withColumn("round_trip", again.eqNullSafe(F.col("_source"))).drop("_source")


def loss_texts(formatted: Column, starts: Column, spans: Column) -> Column:
    """Unescaped texts under the mask, in order; each is cut from its own turn, so the work
    is proportional to the conversation."""
    parts = F.filter(F.arrays_zip(bodies(formatted).alias("body"), starts.alias("start"), spans.alias("span")),
                     lambda x: x["span"].isNotNull())
    return F.transform(parts, lambda x: unescape_text(F.substr(
        x["body"], (x["span"]["start"] - x["start"] - len(START) + 1).cast("int"),
        (x["span"]["end"] - x["span"]["start"]).cast("int"))))


def read_back(formatted: DataFrame, conv_col: str = "conv_id") -> DataFrame:
    """Counts and digests of what ``format_conversations`` wrote, from its output alone."""
    text = F.col("formatted")
    out = formatted.select(F.col(f"`{conv_col}`"), parse(text).alias("turns"), F.length(text).cast("long").alias("formatted_chars"),
                           F.array_join(loss_texts(text, F.col("turn_starts"), F.col("loss_spans")), "").alias("loss"))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return out.select(F.col(f"`{conv_col}`"), F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"),
                      F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars")
