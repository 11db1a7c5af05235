"""Conversations rebuilt from message rows.

Each conversation is a reply graph: a message follows every message of the turn before, and two
different messages that claim one turn follow each other, which is a cycle. Kahn's algorithm with
ties broken by time orders the graph; what it leaves over reveals clashes, a second root reveals a
hole. Long conversations are ordered in blocks of turns, each with a look at the first message of
the next block, so no task holds a whole one.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palaver.operators.runs import sorted_groups
from palaver.session import cut

BLOCK = 512

# What stands for saying nothing, apart from texts without a letter or digit and texts
# that are one bracketed note.
PLACEHOLDERS = ("null", "none", "nil", "n/a", "na", "nan", "empty", "no response", "no reply", "timeout", "blank", "undefined")

#: Wordings of the Moderator's that are broadcast; more of them are joined.
MOST_WORDINGS = 200_000


def speaker(agent: Column) -> Column:
    """``moderator``, ``player<N>``, or the lower-case name without spaces and marks; '' for null."""
    a = F.regexp_replace(F.lower(F.coalesce(agent, F.lit(""))), r"[^\p{L}\p{N}]+", "")
    return F.when(a.contains("moderator"), "moderator").when(a.rlike(r"^player0*[0-9]+$"), F.regexp_replace(a, "^player0*(?=[0-9])", "player")).otherwise(a)


def says(content: Column) -> Column:
    """Whether a content says something: not null, blank, a mark, a placeholder or a bare note."""
    t = F.trim(F.lower(F.coalesce(content, F.lit(""))))
    bare = F.trim(F.regexp_replace(t, r"^[\s\p{P}\p{S}]+|[\s\p{P}\p{S}]+$", ""))
    note = t.rlike(r"^\s*(<[^<>]*>|\[[^\[\]]*\]|\([^()]*\)|\{[^{}]*\})\s*$")
    return (bare != "") & ~note & ~bare.isin(*PLACEHOLDERS)


def to_all(visible: Column) -> Column:
    """Whether a message goes to everybody: ``all`` in any shape, or a list of three names or more."""
    names = F.filter(F.split(F.regexp_replace(F.lower(F.coalesce(visible, F.lit(""))), r"[\[\]\"'{}()]", ""), r"[,;|]"), lambda x: F.trim(x) != "")
    cleaned = F.transform(names, lambda x: F.trim(x))
    return F.array_contains(cleaned, "all") | F.array_contains(cleaned, "everyone") | (F.size(F.array_distinct(cleaned)) >= 3)


def wording(text: Column) -> Column:
    """The content with player names, numbers and inner capitalised words masked."""
    t = F.regexp_replace(text, r"(?i)player[ _]?\d+", "P")
    t = F.regexp_replace(t, r"(?<=[\p{Ll},;] )\p{Lu}[\p{L}]+", "N")
    return F.lower(F.regexp_replace(t, r"\d+", "9"))


def messages(df: DataFrame) -> DataFrame:
    """The rows of ``df`` with what verdicts need of them; no text is kept.

    ``same`` is the hash of the content but for spacing: rows of one turn and speaker with the same
    content are one message, however often it came. Needs episode_id, message_id, agent_name, turn,
    content, visible_to, sent_at; other columns are ignored.
    """
    text = squeezed(F.col("content"))
    named = F.array_distinct(F.regexp_extract_all(F.lower(F.col("text")), F.lit(r"player[ _]?0*(\d+)"), F.lit(1)))
    moderated = F.col("speaker") == "moderator"
    one = df.select("episode_id", F.col("turn").cast("long").alias("turn"), speaker(F.col("agent_name")).alias("speaker"), text.alias("text"), "message_id", "sent_at", to_all(F.col("visible_to")).alias("to_all"))
    return one.select(
        "episode_id", "turn", "speaker", F.xxhash64("text").alias("same"), "sent_at", "message_id", "to_all", says(F.col("text")).alias("says"),
        F.when(moderated, F.xxhash64(wording(F.col("text")))).alias("wording"),
        F.when(moderated & (F.size(named) == 1), F.concat(F.lit("player"), F.element_at(named, 1))).alias("addressee"),
    )


def squeezed(content: Column) -> Column:
    """A content without outer and repeated spaces; '' for null."""
    return F.trim(F.regexp_replace(F.coalesce(content, F.lit("")), r"(?U)\s+", " "))


_CARRIED = ("message_id", "speaker", "same", "to_all", "says", "wording", "addressee")


def _kahn(key: tuple, rows: list[dict]) -> Iterator[tuple]:
    """Orders one block; rows with ``ahead`` are the next block's first turn and only looked at."""
    if key[1] is None:
        for r in rows:
            yield (*key, None, None, False, 0, r["spoken"], *(r[c] for c in _CARRIED), None, False)
        return
    by: dict[int, list[int]] = {}
    for i, r in enumerate(rows):
        by.setdefault(r["turn"], []).append(i)
    waits = [0] * len(rows)
    after: list[list[int]] = [[] for _ in rows]
    for t, here in by.items():
        for i in here:
            for j in by.get(t - 1, ()):
                after[j].append(i)
                waits[i] += 1
            for j in here:
                if i != j:
                    after[j].append(i)
                    waits[i] += 1
    rank = lambda i: (rows[i]["turn"], rows[i]["sent_at"] is None, rows[i]["sent_at"], rows[i]["message_id"] or 0, i)
    ready = [rank(i) for i in range(len(rows)) if not waits[i]]
    roots = sum(not rows[r[-1]]["ahead"] for r in ready)
    heapq.heapify(ready)
    order: list[int] = []
    while ready:
        i = heapq.heappop(ready)[-1]
        order.append(i)
        for j in after[i]:
            waits[j] -= 1
            if not waits[j]:
                heapq.heappush(ready, rank(j))
    placed = set(order)
    for k, i in enumerate(order):
        r = rows[i]
        if not r["ahead"]:
            n = rows[order[k + 1]] if k + 1 < len(order) else None
            yield (key[0], key[1], r["turn"], k + 1, False, roots, r["spoken"], *(r[c] for c in _CARRIED), n and n["speaker"], bool(n and n["says"]))
    for i, r in enumerate(rows):
        if i not in placed and not r["ahead"]:
            yield (key[0], key[1], r["turn"], None, True, roots, r["spoken"], *(r[c] for c in _CARRIED), None, False)


def ordered(msgs: DataFrame) -> DataFrame:
    """Each message with its place in the reply graph's order (``block``, ``place``).

    One aggregation takes repeated messages away and finds clashes: of several different messages
    that claim one turn the first and last by speaker and content enter the graph, which is enough
    for a cycle. ``left_over`` marks what Kahn's algorithm could not place; ``spoken`` whether a
    player says something in the turn. Messages without turn take no place: those of a conversation
    come out as one row with null turn and place.
    """
    body = F.struct("speaker", "same", "sent_at", "message_id", "to_all", "says", "wording", "addressee")
    slot = msgs.groupBy("episode_id", "turn").agg(F.min(body).alias("a"), F.max(body).alias("b"), F.max(F.col("says") & (F.col("speaker") != "moderator")).alias("spoken"))
    clash = F.col("turn").isNotNull() & ((F.col("a.speaker") != F.col("b.speaker")) | (F.col("a.same") != F.col("b.same")))
    nodes = slot.select("episode_id", "turn", "spoken", F.explode(F.when(clash, F.array("a", "b")).otherwise(F.array("a"))).alias("m")).select("episode_id", "turn", "spoken", "m.*")
    block = F.floor(F.col("turn") / BLOCK)
    own = F.struct(block.alias("block"), F.lit(False).alias("ahead"))
    # The first turn of a block is also in the block before, to be looked at.
    both = F.when(F.col("turn") % BLOCK == 0, F.array(own, F.struct((block - 1).alias("block"), F.lit(True).alias("ahead")))).otherwise(F.array(own))
    rows = nodes.select("*", F.explode(both).alias("at")).select("*", "at.block", "at.ahead").drop("at")
    kinds = dict(nodes.dtypes)
    return sorted_groups(
        rows, ["episode_id", "block"], ["turn"], _kahn,
        f"episode_id {kinds['episode_id']}, block long, turn long, place int, left_over boolean, roots int, spoken boolean, message_id {kinds['message_id']}, speaker string, same long, to_all boolean, says boolean, "
        "wording long, addressee string, next_speaker string, next_says boolean",
    )


def _looked_up(rows: DataFrame, known: DataFrame, key: Column, as_: str, few: bool) -> DataFrame:
    """A left join with what is known of a wording: broadcast, or salted as one wording may be in very many rows."""
    k = known.withColumnRenamed("wording", as_)
    if few:
        return rows.join(F.broadcast(k), key == F.col(as_), "left").drop(as_)
    salt = rows.withColumn("__s", F.pmod(F.xxhash64("episode_id"), F.lit(64)))
    wide = k.withColumn("__z", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(63).cast("long"))))
    return salt.join(wide, (key == F.col(as_)) & (F.col("__s") == F.col("__z")), "left").drop(as_, "__s", "__z")


def verdicts(order: DataFrame, most: int = MOST_WORDINGS) -> DataFrame:
    """Each conversation with ``reason``: ``empty``, ``broken``, ``missing_reply`` or null if kept.

    Whether a wording of the Moderator's opens or closes conversations, and whether it calls on the
    player it names, are shares over all conversations: it does if it does in half of its uses,
    however few they are. The wordings are broadcast if there are no more than ``most``, else joined.
    """
    placed = order.where("turn is not null")
    end = F.struct("speaker", "to_all", "wording")
    span = order.groupBy("episode_id").agg(
        F.min("turn").alias("t0"), F.max("turn").alias("t1"), F.countDistinct("turn").alias("turns"), F.max(F.when(F.col("turn").isNotNull(), F.col("left_over"))).alias("clash"), F.max("spoken").alias("spoken"),
        F.min_by(F.when(F.col("turn").isNotNull(), end), "turn").alias("first"), F.max_by(F.when(F.col("turn").isNotNull(), end), "turn").alias("last"),
    )
    span = cut(span)
    use = placed.where("speaker = 'moderator'").groupBy("wording").agg(F.count("*").alias("n"), F.count("addressee").alias("n_named"), F.sum((F.col("next_speaker") == F.col("addressee")).cast("int")).alias("n_answered"))
    zero = F.lit(0).cast("long")
    ends = span.select(F.explode(F.array(F.struct(F.col("first.wording").alias("wording"), F.lit(1).alias("k"), F.lit(0).alias("z")), F.struct(F.col("last.wording").alias("wording"), F.lit(0).alias("k"), F.lit(1).alias("z")))).alias("e")).groupBy("e.wording").agg(F.sum("e.k").alias("n_first"), F.sum("e.z").alias("n_last"))
    known = use.join(ends, "wording", "left").select(
        "wording", (F.coalesce("n_first", zero) * 2 >= F.col("n")).alias("opens"), (F.coalesce("n_last", zero) * 2 >= F.col("n")).alias("closes"),
        (F.coalesce("n_answered", zero) * 2 >= F.greatest("n_named", F.lit(1))).alias("calls"),
    )
    known = cut(known)
    few = known.limit(most + 1).count() <= most
    called = placed.where(F.col("addressee").isNotNull() & (F.coalesce(F.col("next_speaker") == F.col("addressee"), F.lit(False)) & F.col("next_says") == F.lit(False))).select("episode_id", "wording")
    missing = _looked_up(called, known.select("wording", "calls"), F.col("wording"), "w0", few).where("calls").groupBy(F.col("episode_id").alias("e2")).agg(F.lit(True).alias("missing"))
    framed = _looked_up(span, known.select("wording", "opens"), F.col("first.wording"), "w1", few)
    framed = _looked_up(framed, known.select("wording", "closes"), F.col("last.wording"), "w2", few)
    good = (
        (F.col("first.speaker") == "moderator") & F.col("first.to_all") & F.coalesce("opens", F.lit(True)) & (F.col("last.speaker") == "moderator") & F.col("last.to_all")
        & F.coalesce("closes", F.lit(True)) & ~F.col("clash") & (F.col("t1") - F.col("t0") + 1 == F.col("turns")) & (F.col("t1") > F.col("t0")) & F.col("t0").isin(0, 1)
    )
    joined = framed.join(missing, F.col("episode_id").eqNullSafe(F.col("e2")), "left")
    return joined.select(
        "episode_id",
        F.when(~F.col("spoken"), "empty").when(~F.coalesce(good, F.lit(False)), "broken").when(F.col("missing"), "missing_reply").alias("reason"),
    )


def rebuild(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(verdicts, messages in order with role) of all conversations in ``df``.

    Nulls anywhere are allowed: a null turn takes no place, a null content says nothing, a null
    conversation id is one conversation. An empty table gives two empty results. Of three or more
    messages that claim one turn two stand for all; such a conversation is broken.
    """
    order = cut(ordered(messages(df)))
    return verdicts(order), order


def conversations(df: DataFrame) -> DataFrame:
    """The messages of the kept conversations in order, with ``speaker_role`` and ``position``.

    Every different message of a kept conversation comes out; one without a turn has no position.
    """
    verdict, order = rebuild(df)
    first = order.groupBy("episode_id").agg(F.min("turn").alias("t0"))
    here = verdict.where("reason is null").select("episode_id").join(first, "episode_id")
    # A turn of a kept conversation has one message, which came one or several times.
    text = F.xxhash64(squeezed(F.col("content")))
    msgs = df.select("episode_id", F.col("turn").cast("long").alias("turn"), speaker(F.col("agent_name")).alias("speaker"), text.alias("same"), F.struct("sent_at", "message_id", to_all(F.col("visible_to")).alias("to_all"), squeezed(F.col("content")).alias("content")).alias("m"))
    one = msgs.groupBy("episode_id", "turn", "speaker", "same").agg(F.min("m").alias("m"))
    # In a kept conversation turns run without hole from t0, so the position follows from the turn.
    return one.join(here, "episode_id").select(
        "episode_id", (F.col("turn") - F.col("t0") + 1).alias("position"), "m.message_id",
        F.when(F.col("speaker") == "moderator", "moderator").otherwise("player").alias("speaker_role"), "speaker", "m.to_all", "m.content",
    )
