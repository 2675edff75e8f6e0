"""Reply order of conversations by linking quotations.

A message is parsed into lines with a quote level ("> > text" is level 2); consecutive lines of one level are a
passage, whatever width they are wrapped to. Normalised passages are hashed and joined with the last earlier
message of their conversation that says the same, as a paragraph or as a line. A passage that nobody said as a whole is
looked for by its runs of five words, of which the same message must say ``SHARED``, and then line by line. The message
that most words at level 1 are from is what a message replies to. One that quotes nothing goes on in the thread of the
message before it. The result is each conversation in reply order: thread by thread, inside a thread by turn, quotes
taken out.

Only what is quoted anywhere is looked for, so a line that everybody says costs nothing, and word runs are cut only in
conversations that quote. Conversations
may hold a third of all rows, and so may a line: rows are never ordered over a whole key. They are ordered in
slices of turns, and the slices' ends, a few rows each, are carried on from slice to slice.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tagloom.session import stable

SLICE = 1024  # turns
RUN = 5  # words
SHARED = 0.8  # of a passage's runs
WHOLE, LINE, WORDS = 0, 1, 2  # what a hash stands for
BLOCK, LEVEL, BREAK = "\x01", "\x02", "\x03"  # marks before a passage, after its level, between its lines
MARKS = r"^(?:[ \t]*>)+"
ATTRIBUTION = r"(?i)^\s*on .{0,200} wrote:\s*$"


def _lines(text: Column) -> Column:
    """Lines as (level, said): the number of quote marks before the line, and the rest."""
    def line(raw: Column) -> Column:
        marks = F.regexp_extract(raw, MARKS, 0)
        return F.struct(F.length(F.regexp_replace(marks, "[^>]", "")).alias("level"),
                        F.regexp_replace(raw, MARKS, "").alias("said"))

    return F.transform(F.split(text, r"\r?\n"), line)


def _normal(said: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(said), r"[\s\x01-\x03]+", " "))


def _own_text() -> Column:
    """The message without quoted lines and without the line that announces a quotation."""
    def announces(line: Column, i: Column) -> Column:
        return (line["level"] == 0) & line["said"].rlike(ATTRIBUTION) & (F.get("lines", i + 1)["level"] > 0)

    kept = F.filter("lines", lambda line, i: (line["level"] == 0) & ~F.coalesce(announces(line, i), F.lit(False)))
    return F.regexp_replace(F.array_join(F.transform(kept, lambda line: line["said"]), "\n"), r"^\n+|\n+$", "")


def last_before(rows: DataFrame, keys: list[str], value: Column, including: bool) -> DataFrame:
    """Add ``found``: the last non-null ``value`` of an earlier turn of the same keys, or of the same turn too.

    A running window inside slices of turns; what a slice ends with is carried to later ones by a window over
    one row per slice.
    """
    sliced = rows.withColumn("_slice", F.floor(F.col("turn") / SLICE)).withColumn("_value", value)
    inside = Window.partitionBy(*keys, "_slice").orderBy("turn").rangeBetween(
        Window.unboundedPreceding, 0 if including else -1)
    latest = F.max(F.when(F.col("_value").isNotNull(), F.struct("turn", "_value")))
    ends = sliced.groupBy(*keys, "_slice").agg(latest.alias("_end"))
    across = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select(*[F.col(k).alias(f"_k_{k}") for k in keys], F.col("_slice").alias("_s"),
                          F.max("_end").over(across).alias("_carried"))
    met = sliced.withColumn("_here", latest.over(inside))
    same = F.col("_slice").eqNullSafe(F.col("_s"))
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    return met.join(carried, same, "left").withColumn(
        "found", F.coalesce("_here", "_carried")["_value"]).drop(
            "_slice", "_value", "_here", "_carried", "_s", *[f"_k_{k}" for k in keys])


def _marked(line: Column, i: Column) -> Column:
    """A line of the column ``plain`` with the mark that divides it from the one before; a line without words divides too."""
    before = F.get("plain", i - 1)
    goes_on = (i > 0) & (before["level"] == line["level"]) & (before["said"] != "")
    mark = F.when(goes_on, BREAK).otherwise(F.concat(F.lit(BLOCK), line["level"].cast("string"), F.lit(LEVEL)))
    return F.when(line["said"] == "", "").otherwise(F.concat(mark, line["said"]))


def _block(text: Column) -> Column:
    cut = F.split(text, LEVEL)
    return F.struct(cut[0].cast("int").alias("level"), cut[1].alias("lines"))


def parsed(messages: DataFrame, conversation: str = "conv_id", turn: str = "turn", role: str = "role",
           text: str = "text") -> DataFrame:
    """(row, conv, turn, role, text, quoted, own): own text, the quoted passages as (level, lines), and the hashes of the
    paragraphs and lines that the message says itself."""
    cut = messages.select(
        F.monotonically_increasing_id().alias("row"), F.col(conversation).alias("conv"), F.col(turn).cast("long").alias("turn"),
        F.col(role).alias("role"), _lines(F.coalesce(F.col(text), F.lit(""))).alias("lines"))
    plain = cut.select("*", F.transform("lines", lambda line: F.struct(line["level"].alias("level"), _normal(line["said"]).alias("said"))).alias("plain"))
    joined = plain.select("row", "conv", "turn", "role", _own_text().alias("text"), F.array_join(F.transform("plain", _marked), "").alias("marked"))
    blocks = joined.select("*", F.transform(F.filter(F.split("marked", BLOCK), lambda b: b != ""), _block).alias("blocks"))
    said = F.filter("blocks", lambda b: b["level"] == 0)
    paragraphs = F.transform(said, lambda b: F.xxhash64(F.replace(b["lines"], F.lit(BREAK), F.lit(" "))))
    lines = F.transform(F.flatten(F.transform(said, lambda b: F.split(b["lines"], BREAK))), lambda line: F.xxhash64(line))
    return blocks.select("row", "conv", "turn", "role", "text", F.filter("blocks", lambda b: b["level"] > 0).alias("quoted"),
                         F.array_union(paragraphs, lines).alias("own"))


def _runs() -> Column:
    """Hashes of all runs of the column ``words``; none of fewer words."""
    hashed = F.transform(F.sequence(F.lit(1), F.size("words") - (RUN - 1)), lambda i: F.xxhash64(F.array_join(F.slice("words", i, RUN), " ")))
    return F.when(F.size("words") >= RUN, hashed).otherwise(F.array().cast("array<bigint>"))


def links(rows: DataFrame) -> DataFrame:
    """(row, passage, level, n_words, origin): the quoted passages of ``parsed`` rows with the turn of the message they are from."""
    passages = rows.filter(F.size("quoted") > 0).select("row", "conv", "turn", F.posexplode("quoted").alias("passage", "b")).select(
        "row", "conv", "turn", "passage", "b.level", "b.lines", F.replace("b.lines", F.lit(BREAK), F.lit(" ")).alias("whole"))
    passages = passages.select("*", F.split("whole", " ").alias("words"))

    def of_kind(kind: int, hashes: Column) -> Column:
        return F.transform(hashes, lambda h: F.struct(F.lit(kind).alias("kind"), h.alias("hash")))

    names = ["row", "conv", "turn", "passage", "level", "n_words"]
    quoted = stable(passages.select(*names[:-1], F.size("words").alias("n_words"), F.inline(F.concat(
        of_kind(WHOLE, F.array(F.xxhash64("whole"))), of_kind(LINE, F.transform(F.split("lines", BREAK), lambda line: F.xxhash64(line))),
        of_kind(WORDS, _runs())))), "quoted")
    wanted = quoted.select(F.col("conv").alias("_c"), F.col("hash").alias("_h")).distinct()
    quoting = wanted.select("_c").distinct()
    # semi joins first: only conversations that quote, and only what somebody quotes, go on
    here = rows.join(quoting, F.col("conv").eqNullSafe(F.col("_c")), "left_semi")
    said = here.select("conv", "turn", F.explode("own").alias("hash")).unionByName(
        here.select("conv", "turn", F.split(_normal(F.col("text")), " ").alias("words")).select("conv", "turn", F.explode(_runs()).alias("hash")))
    origins = said.join(wanted, F.col("conv").eqNullSafe(F.col("_c")) & (F.col("hash") == F.col("_h")), "left_semi").distinct()
    nothing = [F.lit(None).cast(t).alias(n) for n, t in quoted.dtypes if n not in ("conv", "turn", "hash")]
    both = quoted.withColumn("said_at", F.lit(None).cast("long")).unionByName(
        origins.select("conv", "hash", "turn", *nothing, F.col("turn").alias("said_at")))
    met = last_before(both, ["conv", "hash"], F.col("said_at"), False).filter(F.col("row").isNotNull())
    votes = met.groupBy("row", "passage", "level", "n_words", "kind", F.col("found").alias("origin")).agg(F.count(F.lit(1)).alias("n"))

    def best(kind: int) -> Column:
        return F.max(F.when((F.col("kind") == kind) & F.col("origin").isNotNull(), F.struct("n", "origin")))

    runs = F.sum(F.when(F.col("kind") == WORDS, F.col("n")))
    chosen = votes.groupBy("row", "passage", "level", "n_words").agg(
        best(WHOLE).alias("whole"), best(LINE).alias("line"), best(WORDS).alias("run"), runs.alias("runs"))
    origin = F.coalesce("whole.origin", F.when(F.col("run.n") >= SHARED * F.col("runs"), F.col("run.origin")), "line.origin")
    return chosen.select("row", "passage", "level", "n_words", origin.alias("origin"))


def threads(messages: DataFrame, conversation: str = "conv_id", turn: str = "turn", role: str = "role",
            text: str = "text") -> DataFrame:
    """One row per message: conv, turn, role, reply_to, thread, position, n_quoted, n_linked, text (without quotes).

    ``reply_to`` is the turn replied to, ``thread`` the turn that starts the thread, ``position`` the place in
    the conversation in reply order, from 0; ``n_quoted`` and ``n_linked`` count quoted passages. The first message of a conversation, and one that quotes only what
    nobody said before, starts a thread. A null text is empty. Messages that repeat a conversation and a turn keep rows of
    their own and stand beside each other; a null turn counts as the first, a null conversation is a conversation.
    """
    rows = stable(parsed(messages.withColumn(turn, F.coalesce(F.col(turn), F.lit(-1))), conversation, turn, role, text), "messages")
    linked = links(rows)
    votes = linked.filter((F.col("level") == 1) & F.col("origin").isNotNull()).groupBy("row", "origin").agg(F.sum("n_words").alias("n"))
    chosen = votes.groupBy("row").agg(F.max(F.struct("n", "origin"))["origin"].alias("origin"))
    counted = linked.groupBy("row").agg(F.count(F.lit(1)).alias("n_quoted"), F.count("origin").alias("n_linked"))
    known = stable(
        rows.select("row", "conv", "turn").join(counted, "row", "left").join(chosen, "row", "left")
        .withColumn("starts", F.col("origin").isNull() & F.col("n_quoted").isNotNull()), "replies")
    # what a message without quotes follows: the last message that starts a thread or quotes
    marked = known.withColumn("head", F.when(F.col("origin").isNotNull() | F.col("starts"), F.col("turn")))
    first = known.groupBy("conv").agg(F.min("turn").alias("first_turn"))
    follows = last_before(marked, ["conv"], F.col("head"), True).join(
        first.withColumnRenamed("conv", "_c"), F.col("conv").eqNullSafe(F.col("_c"))).drop("_c")
    headed = follows.withColumn("head", F.coalesce("found", "first_turn")).drop("found")
    headed = stable(last_before(headed, ["conv"], F.col("turn"), False).withColumnRenamed("found", "previous"), "heads")
    # the heads' own threads, by jumping from head to the head of what it quotes until nothing moves
    jumps = headed.groupBy("conv", "turn").agg(F.max("head").alias("head"), F.max("origin").alias("origin"))
    heads = jumps.filter("head = turn").select("conv", "turn", "origin")
    named = jumps.select(F.col("conv").alias("_c"), F.col("turn").alias("_t"), F.col("head").alias("up"))
    up = stable(heads.join(named, F.col("conv").eqNullSafe(F.col("_c")) & (F.col("origin") == F.col("_t")), "left").select(
        "conv", F.col("turn").alias("head"), F.coalesce("up", "turn").alias("up")), "jumps")
    while True:
        above = up.select(F.col("conv").alias("_c"), F.col("head").alias("_h"), F.col("up").alias("further"))
        next_ = stable(up.join(above, F.col("conv").eqNullSafe(F.col("_c")) & (F.col("up") == F.col("_h")), "left").select(
            "conv", "head", F.coalesce("further", "up").alias("up"), (F.coalesce("further", "up") != F.col("up")).alias("moved")), "jumps")
        moved = next_.filter("moved").limit(1).count()
        up = next_.drop("moved")
        if not moved:
            break
    roots = up.select(F.col("conv").alias("_c"), F.col("head").alias("_h"), F.col("up").alias("thread"))
    placed = headed.join(roots, F.col("conv").eqNullSafe(F.col("_c")) & (F.col("head") == F.col("_h")), "left").withColumn(
        "thread", F.coalesce("thread", "head")).drop("_c", "_h")
    placed = placed.withColumn("_slice", F.floor(F.col("turn") / SLICE))
    sizes = placed.groupBy("conv", "thread", "_slice").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("conv").orderBy("thread", "_slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(F.col("conv").alias("_c"), F.col("thread").alias("_t"), F.col("_slice").alias("_s"),
                          F.coalesce(F.sum("n").over(before), F.lit(0)).alias("earlier"))
    inside = Window.partitionBy("conv", "thread", "_slice").orderBy("turn", "row")
    numbered = placed.withColumn("place", F.row_number().over(inside)).join(
        starts, F.col("conv").eqNullSafe(F.col("_c")) & (F.col("thread") == F.col("_t")) & (F.col("_slice") == F.col("_s")))
    reply = F.when(F.col("starts"), F.lit(None)).otherwise(F.coalesce("origin", "previous"))
    out = numbered.select("row", reply.alias("reply_to"), "thread", (F.col("earlier") + F.col("place") - 1).alias("position"),
                          F.coalesce("n_quoted", F.lit(0)).alias("n_quoted"), F.coalesce("n_linked", F.lit(0)).alias("n_linked"))
    return rows.select("row", "conv", "turn", "role", "text").join(out, "row").select(
        "conv", "turn", "role", "reply_to", "thread", "position", "n_quoted", "n_linked", "text")


def chat(messages: DataFrame, **names: str) -> DataFrame:
    """Each message as a line of a chat template, in reply order: (conv, thread, position, line)."""
    line = F.concat(F.lit("<|"), F.coalesce("role", F.lit("user")), F.lit("|>\n"), F.col("text"), F.lit("\n<|end|>"))
    return threads(messages, **names).select("conv", "thread", "position", line.alias("line"))
