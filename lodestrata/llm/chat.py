r"""Chat formatting of reply trees, DataFrame functions only.

Messages name their parent. Ancestors are found by iterative self-joins that
double the distance each time, so a thread of depth d takes log2(d) + 1 joins,
each keyed on (conversation, message). Root-to-leaf paths are ranked by the sum
of their messages' scores (ties: the smaller leaf) before any of them is listed,
and every chosen path is written as one conversation::

    ### role: text</turn>\n

Inside texts and roles ``\`` is written ``\b``, ``</turn>`` ``\e``, ``### ``
``\h``, and in roles ``: `` is ``\c``; reading back undoes it exactly. The loss
mask covers the text of each assistant turn, as spans of the written text; what
is digested as loss is cut out of that text by these spans.

Defined results: a null text or role is empty; a null conversation id is a
conversation of its own; a message whose parent is missing, or not before it,
is a root; equal rows are messages of their own, ordered by role and text; an
empty table gives no conversations; columns that are not named here are left
out, whatever their names. A chosen path is one row, however long, so its texts
must fit one value (2 GB) and meet in one task; other paths are not gathered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestrata.llm.scratch import Scratch

END = "</turn>"
HEAD = "### "
#: Fixed escapes, in the order in which they are written.
ESCAPES = (("\\", "\\b"), (END, "\\e"), (HEAD, "\\h"))
SEP = ": "
#: Code points of the pieces in which spans are looked up.
PIECE = 4096


def escaped(text: Column) -> Column:
    for plain, code in ESCAPES:
        text = F.replace(text, F.lit(plain), F.lit(code))
    return text


def unescaped(text: Column) -> Column:
    for plain, code in reversed(ESCAPES):
        text = F.replace(text, F.lit(code), F.lit(plain))
    return text


def chain(messages: DataFrame) -> DataFrame:
    """Rows by turn as trees of one branch: each message answers the one before."""
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    numbered = messages.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    return numbered.withColumn("msg", F.row_number().over(order).cast("long")).select("conv_id", "msg", F.when(F.col("msg") > 1, F.col("msg") - 1).alias("parent"), "role", "text", F.lit(0.0).alias("score"))


def reply_paths(messages: DataFrame, *, paths_per_tree: int = 1, scratch: Scratch | None = None) -> DataFrame:
    """(conv_id, root, leaf, rank, msg, back): the messages of each chosen path,
    ``back`` steps before its leaf. Takes (conv_id, msg, parent, score). Scores
    are summed while the distance doubles, so branches are ranked by one row a
    leaf, and only the chosen ones are listed message by message."""
    scratch = scratch or Scratch(messages.sparkSession)
    same = lambda a, b: F.col("conv_id").eqNullSafe(F.col("c")) & (F.col(a) == F.col(b))
    known = messages.select(F.col("conv_id").alias("c"), F.col("msg").alias("p"))
    links = messages.where("parent < msg").join(known, same("parent", "p"), "left_semi").select(F.col("conv_id").alias("c"), F.col("msg").alias("m"), F.col("parent").alias("up"))
    # the message 2**k steps up, the farthest one known, and the scores from here to below the former
    state = messages.select("conv_id", "msg", F.coalesce("score", F.lit(0.0)).alias("total")).join(links, same("msg", "m"), "left")
    state = scratch.keep(state.select("conv_id", "msg", "up", F.coalesce("up", "msg").alias("root"), "total"))
    levels, ended = [state.where("up is not null")], state.where("up is null")
    while not levels[-1].isEmpty():
        # only messages that are not at their root go on; those they meet may have ended
        hop = levels[-1].unionByName(ended).select(F.col("conv_id").alias("c"), F.col("msg").alias("m"), F.col("up").alias("up_"), F.col("root").alias("root_"), F.col("total").alias("more"))
        state = scratch.keep(levels[-1].join(hop, same("up", "m")).select("conv_id", "msg", F.col("up_").alias("up"), F.col("root_").alias("root"), (F.col("total") + F.col("more")).alias("total")))
        levels.append(state.where("up is not null"))
        ended = ended.unionByName(state.where("up is null"))
    # the leaves are the messages that none answers
    answered = levels[0].select(F.col("conv_id").alias("c"), F.col("up").alias("p")).distinct()
    branch = ended.join(answered, same("msg", "p"), "left_anti").withColumn("rank", F.row_number().over(Window.partitionBy("conv_id", "root").orderBy(F.desc("total"), "msg")))
    path = scratch.keep(branch.where(F.col("rank") <= paths_per_tree).select("conv_id", "root", F.col("msg").alias("leaf"), "rank", "msg", F.lit(0).cast("long").alias("back")))
    for k, level in enumerate(levels[:-1]):
        hop = level.select(F.col("conv_id").alias("c"), F.col("msg").alias("m"), "up")
        further = path.join(hop, same("msg", "m")).select("conv_id", "root", "leaf", "rank", F.col("up").alias("msg"), (F.col("back") + 2**k).alias("back"))
        path, before = scratch.keep(path.unionByName(further)), path
        scratch.drop(before)
    return path


def format_chats(messages: DataFrame, *, paths_per_tree: int = 1) -> DataFrame:
    """(conv_id, root, leaf, rank, formatted, loss): one row a chosen path.
    ``loss`` lists the masked spans as (start, end) in code points."""
    scratch = Scratch(messages.sparkSession)
    messages = scratch.keep(messages)
    head = F.concat(F.lit(HEAD), F.replace(escaped(F.col("role")), F.lit(SEP), F.lit("\\c")), F.lit(SEP))
    paths = reply_paths(messages, paths_per_tree=paths_per_tree, scratch=scratch)
    turns = messages.select(F.col("conv_id").alias("c"), F.col("msg").alias("m"), head.alias("head"), escaped(F.col("text")).alias("body"), (F.col("role") == "assistant").alias("loss"))
    rows = paths.join(turns, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("msg") == F.col("m")))
    # a path is one row of the output, so its turns meet in one task by definition
    path = ["conv_id", "root", "leaf", "rank"]
    ahead = Window.partitionBy(*path).orderBy(F.desc("back")).rowsBetween(Window.unboundedPreceding, -1)
    whole = F.length("head") + F.length("body") + len(END) + 1
    start = F.coalesce(F.sum(whole).over(ahead), F.lit(0)) + F.length("head")
    rows = rows.withColumn("start", start.cast("int")).withColumn("end", F.col("start") + F.length("body"))
    turn = F.struct((-F.col("back")).alias("at"), F.concat("head", "body", F.lit(END + "\n")).alias("written"), "loss", "start", "end")
    found = rows.groupBy(*path).agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    spans = F.transform(F.filter("turns", lambda t: t["loss"]), lambda t: F.struct(t["start"].alias("start"), t["end"].alias("end")))
    return found.select(*path, F.array_join(F.col("turns.written"), "").alias("formatted"), spans.alias("loss"))


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def cut(text: Column, spans: Column) -> Column:
    """The parts of a text that spans (start, end) name. The text is cut into
    pieces first, so that a span costs no walk through all that lies before it."""

    def part(pieces: Column, s: Column) -> Column:
        first = F.floor(s["start"] / PIECE).cast("int")
        held = F.slice(pieces, first + 1, F.floor(s["end"] / PIECE).cast("int") - first + 1)
        return F.substring(F.array_join(held, ""), s["start"] - first * PIECE + 1, s["end"] - s["start"])

    return _let(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0)), lambda pieces: F.transform(spans, lambda s: part(pieces, s)))


def read_chats(chats: DataFrame) -> DataFrame:
    """``format_chats`` undone: adds turns, an array of (role, text), and
    masked, the unescaped texts that the spans of ``loss`` cut out of
    ``formatted``."""
    segments = F.filter(F.split("formatted", r"\Q</turn>\E\n", -1), lambda s: s != "")

    def parsed(s: Column) -> Column:
        at = F.instr(s, SEP)
        role = unescaped(F.replace(F.substring(s, F.lit(len(HEAD) + 1), at - len(HEAD) - 1), F.lit("\\c"), F.lit(SEP)))
        return F.struct(role.alias("role"), unescaped(F.substring(s, at + len(SEP), F.length(s))).alias("text"))

    return chats.withColumns({"turns": F.transform(segments, parsed), "masked": F.transform(cut(F.col("formatted"), F.col("loss")), unescaped)})


def chat_digests(messages: DataFrame) -> DataFrame:
    """What the formatted conversations hold, read back from them."""
    return digests(read_chats(format_chats(messages)))


def digests(read: DataFrame) -> DataFrame:
    """The figures of conversations that were read back."""
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    masked = F.array_join("masked", "")
    return read.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"), F.length(masked).cast("long").alias("loss_chars"), F.sha2(masked, 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"),
    )
