"""Transcript lines into clean, ordered speaker turns.

Labels are resolved once for each distinct (game, label). Lines are then ordered by a precedence
graph with edges of three weights: dialogue order (record numbers) is the strongest, then the cue
that ties a line without a name to the line before, then the clock, which leads from each timed line
to the next later one. Kahn's algorithm orders the graph; where a cycle
stops it, the cycle's weakest edge is dropped and counts as a conflict of the turn it led to. Games
are ordered in blocks of record numbers, and only the runs that touch a block's ends are joined
across blocks, so a very long game is no single task.

A sound note is bracketed text of at most 80 characters, a label inside an utterance has at most 40;
longer ones are speech.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from palaver.operators.runs import sorted_groups
from palaver.session import cut
from palaver.tables import first_delivery

BLOCK = 2048
VOICE = "Announcer"

# The words of labels for the game's own voice.
VOICE_WORDS = ("announcer", "narrator", "app", "audio", "game", "moderator", "host", "system", "voice", "recording", "timer", "speaker")
# Hesitation sounds as a pattern of one whole word.
HESITATION = r"(?:u+h+m*|u+m+h*|e+r+m*|e+h+m*|h+m+|m+h*m+|a+h+m*)"
# Filler phrases, which are words (a line of them says something) but leave clean text.
FILLERS = r"you know|i mean|like|sort of|kind of|well"

_TIME = r"\d{1,2}(?::\d{1,2}){1,2}"
_MARK = rf"(?:[\[(<]\s*{_TIME}\s*[\])>]|{_TIME})"
_NOTE = r"\[[^\[\]]{0,80}\]|\([^()]{0,80}\)|\{[^{}]{0,80}\}|<[^<>]{0,80}>|\*[^*]{1,80}\*|♪[^♪]{0,80}♪"
_INLINE = rf"^\s*(?:{_MARK}\s*[-–]?\s*)?((?:>>\s*)?\p{{L}}[\p{{L}}\p{{N}} .#'’_-]{{0,40}}?(?:\s*\([\p{{L}}' ’]{{1,12}}\))*)\s*(?:{_MARK})?\s*:(?!\d)\s*"


def label(text: Column) -> Column:
    """A label without case, clock, continuation mark, arrows, colon and outer spaces; null if blank."""
    t = F.lower(F.regexp_replace(text, "’", "'"))
    for p in (rf"\(\s*{_TIME}\s*\)|\[\s*{_TIME}\s*\]", r"\((?:cont(?:'?d|inued|\.)?|contd\.?)\)", r"^[\s>«\-–]+", r"[\s:]+$"):
        t = F.regexp_replace(t, p, "")
    t = F.trim(F.regexp_replace(t, r"[\s:]+$", ""))
    return F.nullif(F.trim(F.regexp_replace(t, r"\s+", " ")), F.lit(""))


def spoken(text: Column) -> Column:
    """The text without leading clock, sound notes and clocks."""
    t = F.regexp_replace(F.coalesce(text, F.lit("")), _NOTE, " ")
    return F.regexp_replace(t, rf"(?<![\d:]){_TIME}(?![\d:])", " ")


def has_word(said: Column) -> Column:
    """Whether anything but hesitation sounds is said."""
    rest = F.regexp_replace(said, rf"(?i)(?<![\p{{L}}\p{{N}}'’]){HESITATION}(?![\p{{L}}\p{{N}}'’])", " ")
    return rest.rlike(r"[\p{L}\p{N}]")


def clean(said: Column) -> Column:
    """Clean text: no hesitations, fillers set off by commas or stutters, single spaces."""
    t = F.regexp_replace(said, rf"(?i)(?<![\p{{L}}\p{{N}}'’]){HESITATION}(?![\p{{L}}\p{{N}}'’])(?:\.\.\.|[,.…—–-])?", " ")
    t = F.regexp_replace(t, rf"(?i)(?<![\p{{L}}\p{{N}}'’])(?:{FILLERS}),", " ")
    t = F.regexp_replace(t, r"(?i)(?<![\p{L}])([\p{L}']+)[,.]?- (?=\1(?![\p{L}]))", "")
    t = F.regexp_replace(t, r"\s+([,.;:!?])", "$1")
    return F.trim(F.regexp_replace(t, r"\s+", " "))


def resolved(labels: DataFrame, rosters: DataFrame) -> DataFrame:
    """(game_id, label, name): each distinct label under its roster spelling or the game's voice.

    In this order: an exact name, the voice's words, a seat number (seats count from 1), a unique
    beginning of a name, the nearest name within two edits if it is the only nearest. A label that
    fits no player is the game's own voice; without a roster it keeps its own spelling.
    """
    x = labels.join(rosters, "game_id", "left")
    names, lab = F.coalesce("player_names", F.array().cast("array<string>")), F.col("label")
    names = F.filter(names, lambda n: n.isNotNull() & (F.trim(n) != ""))
    low = lambda n: F.lower(F.trim(n))
    exact = F.filter(names, lambda n: low(n) == lab)
    words = F.split(F.regexp_replace(lab, r"[^\p{L}]+", " "), " ")
    is_voice = F.forall(F.filter(words, lambda w: w != ""), lambda w: w.isin(*VOICE_WORDS)) & lab.rlike(r"\p{L}")
    seat = F.try_to_number(F.nullif(F.regexp_extract(lab, r"^(?:player|seat|p)[\s_]*#?\s*0*(\d{1,4})$", 1), F.lit("")), F.lit("9999")).cast("int")
    seated = F.get(F.col("player_names"), seat - 1)
    short = F.regexp_replace(lab, r"\.+$", "")
    begins = F.filter(names, lambda n: (F.length(short) >= 2) & low(n).startswith(short))
    # Edits count double, so that between equally near names the one with the same initial is nearer;
    # swapped letters count as one edit.
    letters = lambda t: F.array_sort(F.split(t, ""))
    edits = lambda n: F.when(letters(low(n)) == letters(short), F.least(F.levenshtein(low(n), short), F.lit(1))).otherwise(F.levenshtein(low(n), short))
    far = lambda n: edits(n) * 2 + (F.substring(low(n), 1, 1) != F.substring(short, 1, 1)).cast("int")
    near = F.array_sort(F.transform(names, lambda n: F.struct(far(n).alias("d"), n.alias("n"))))
    d0, d1 = F.get(near, 0)["d"], F.get(near, 1)["d"]
    close = (d0 <= 5) & (d0 < F.length(short)) & (d1.isNull() | (d1 > d0))
    name = (
        F.when(F.size(exact) > 0, F.get(exact, 0)).when(is_voice, F.lit(VOICE)).when(seat.isNotNull() & seated.isNotNull(), seated)
        .when(F.size(F.array_distinct(begins)) == 1, F.get(begins, 0)).when(close, F.get(near, 0)["n"])
        .when(F.size(names) > 0, F.lit(VOICE)).otherwise(F.initcap(lab))
    )
    return x.select("game_id", "label", F.trim(name).alias("name"), (F.size(exact) > 0).alias("is_exact"), (is_voice | seat.isNotNull() | (F.size(begins) == 1) | close | (F.size(exact) > 0)).alias("is_known"))


ORDER, CUE, CLOCK = 3, 2, 1


def precedence(rows: list[dict]) -> dict[tuple[int, int], int]:
    """Edges (earlier, later) with their weights, of lines sorted by record number and line id."""
    edges: dict[tuple[int, int], int] = {}
    timed = sorted((r["clock"], r["rec_id"], r["line_id"], i) for i, r in enumerate(rows) if r["clock"] is not None)
    for a, b in zip(timed, timed[1:]):
        if a[0] < b[0]:
            edges[a[3], b[3]] = CLOCK
    for i, r in enumerate(rows):
        if i and r["name"] is None:
            edges[i - 1, i] = CUE
    groups: list[list[int]] = []
    for i, r in enumerate(rows):
        if groups and rows[groups[-1][0]]["rec_id"] == r["rec_id"]:
            groups[-1].append(i)
        else:
            groups.append([i])
    for a, b in zip(groups, groups[1:]):
        for i, j in (*((i, j) for i in a[-1:] for j in b), *((i, j) for i in a[:-1] for j in b[:1])):
            edges[i, j] = ORDER
    return edges


def topological(n: int, edges: dict[tuple[int, int], int], rank: Callable[[int], tuple]) -> tuple[list[int], dict[int, int]]:
    """(order, edges dropped by the node they led to) by Kahn's algorithm that drops the weakest edge of each cycle.

    Where it stops, a walk back along the heaviest blocking edges, from the first line that waits,
    ends in a cycle; of its edges the weakest goes.
    """
    after: list[list[int]] = [[] for _ in range(n)]
    before: list[list[tuple[int, int]]] = [[] for _ in range(n)]
    waits = [0] * n
    for (i, j), w in sorted(edges.items(), key=lambda e: (e[1], e[0])):
        after[i].append(j)
        before[j].append((w, i))
        waits[j] += 1
    ready = [rank(i) for i in range(n) if not waits[i]]
    heapq.heapify(ready)
    placed, gone, order, dropped = [False] * n, set(), [], {}
    low = 0
    while len(order) < n:
        while not ready:
            while placed[low]:
                low += 1
            path, at = [low], {low: 0}
            while True:
                j = path[-1]
                while placed[before[j][-1][1]] or (before[j][-1][1], j) in gone:
                    before[j].pop()
                i = before[j][-1][1]
                if i in at:
                    break
                at[i] = len(path)
                path.append(i)
            ring = [*path[at[i] :], i]  # each follows from the next
            i, j = min(((b, a) for a, b in zip(ring, ring[1:])), key=lambda e: (edges[e], rank(e[1])))
            gone.add((i, j))
            dropped[j] = dropped.get(j, 0) + 1
            waits[j] -= 1
            if not waits[j]:
                heapq.heappush(ready, rank(j))
        i = heapq.heappop(ready)[-1]
        placed[i] = True
        order.append(i)
        for j in after[i]:
            if (i, j) not in gone:
                waits[j] -= 1
                if not waits[j]:
                    heapq.heappush(ready, rank(j))
    return order, dropped


def _blocks(key: tuple, rows: list[dict]) -> Iterator[tuple]:
    """Orders a block by its precedence graph and yields its runs; ``edge`` marks those at its ends."""
    order, dropped = topological(len(rows), precedence(rows), lambda i: (rows[i]["rec_id"], rows[i]["line_id"], i))
    runs: list[list] = []
    for i in order:
        r = rows[i]
        if runs and (r["name"] is None or r["name"] == runs[-1][0]):
            runs[-1][2] = r["line_id"]
            runs[-1][3] += 1
            if r["text"]:
                runs[-1][4].append(r["text"])
            runs[-1][5] += dropped.get(i, 0)
        else:
            runs.append([r["name"], r["line_id"], r["line_id"], 1, [r["text"]] if r["text"] else [], dropped.get(i, 0)])
    for k, (name, first, last, lines, texts, conflicts) in enumerate(runs):
        # The second run touches the start too if the first takes its speaker from the block before.
        yield (key[0], key[1], k, k in (0, len(runs) - 1) or (k == 1 and runs[0][0] is None), name, first, last, lines, " ".join(texts), conflicts)


def turns(lines: DataFrame, games: DataFrame, text: bool = True, most_labels: int = 500_000) -> DataFrame:
    """The turns of every game: game_id, first_line_id, last_line_id, speaker, n_lines, n_conflicts, text.

    ``lines`` needs line_id, game_id, rec_id, speaker, time_mark, utterance, loaded_at; ``games``
    game_id, player_names, indexed_at. Other columns are ignored. A line without rec_id has no place
    in its game and is left out, as are lines before the first named speaker. Repeated deliveries
    count once; an empty or null utterance says nothing. Empty tables give an empty result. The
    distinct labels of all games are broadcast if there are no more than ``most_labels``, else joined.
    """
    own = label(F.col("speaker"))
    # Patterns run only where they can matter: most lines have a label of their own.
    named = F.when(own.isNull(), label(F.nullif(F.regexp_extract(F.col("utterance"), _INLINE, 1), F.lit(""))))
    has_inline = own.isNull() & F.col("utterance").rlike(_INLINE)
    parts = F.split(F.regexp_extract("time_mark", _TIME, 0), ":")
    number = lambda p: F.coalesce(F.try_to_number(F.nullif(p, F.lit("")), F.lit("99")), F.lit(0)).cast("int")
    clock = F.aggregate(F.transform(parts, number), F.lit(0), lambda a, b: a * 60 + b)
    # A line is reduced to what turns need of it before anything is shuffled. Whether a label inside
    # the utterance names somebody is known only later: both readings of the line are kept.
    full, rest = spoken(F.col("utterance")), spoken(F.regexp_replace("utterance", _INLINE, ""))
    texts = [clean(full).alias("text_full"), F.when(has_inline, clean(rest)).alias("text_rest")] if text else []
    thin = lines.where(F.col("rec_id").isNotNull()).select(
        "line_id", "game_id", F.col("rec_id").cast("long").alias("rec_id"), "loaded_at", F.coalesce(own, named).alias("label"), (own.isNull() & named.isNotNull()).alias("inline"),
        F.when(F.col("time_mark").rlike(_TIME), clock).alias("clock"), has_word(full).alias("word_full"), F.when(has_inline, has_word(rest)).alias("word_rest"), *texts,
    ).where("word_full")
    once = first_delivery(thin, ["line_id"], "loaded_at", [c for c in thin.columns if c not in ("line_id", "loaded_at")])
    # Repeated games: the earliest index row with a roster counts.
    late = F.coalesce(F.col("indexed_at").cast("timestamp"), F.to_timestamp(F.lit("9999-01-01")))
    rosters = games.where(F.size("player_names") > 0).groupBy("game_id").agg(F.min(F.struct(late.alias("at"), "player_names")).alias("r")).select("game_id", "r.player_names")
    # Distinct labels come from all deliveries, so that no text is shuffled for them.
    who = cut(resolved(lines.select("game_id", F.coalesce(own, named).alias("label")).where("label is not null").distinct(), rosters))
    # The join is on (game, label), so that a game of very many lines is spread over its labels.
    j = once.join(F.broadcast(who) if who.limit(most_labels + 1).count() <= most_labels else who, ["game_id", "label"], "left")
    # A colon after words that name nobody is no label: the line keeps them and names no speaker.
    takes = ~F.col("inline") | F.coalesce("is_known", F.lit(False))
    cut_off = F.col("inline") & takes
    kept = j.where(F.when(cut_off, F.col("word_rest")).otherwise(F.col("word_full"))).select(
        "game_id", "rec_id", "line_id", F.when(takes, F.col("name")).alias("name"), "clock",
        (F.when(cut_off, F.col("text_rest")).otherwise(F.col("text_full")) if text else F.lit(None).cast("string")).alias("text"),
    ).withColumn("block", F.floor(F.col("rec_id") / BLOCK))
    lid, gid = dict(lines.dtypes)["line_id"], dict(lines.dtypes)["game_id"]
    runs = sorted_groups(
        kept, ["game_id", "block"], ["rec_id", "line_id"], _blocks,
        f"game_id {gid}, block long, run int, edge boolean, name string, first {lid}, last {lid}, n_lines long, text string, conflicts long",
    )
    return _stitched(runs)


def _stitched(runs: DataFrame) -> DataFrame:
    inner = runs.where(~F.col("edge")).select("game_id", F.col("first").alias("first_line_id"), F.col("last").alias("last_line_id"), F.col("name").alias("speaker"), "n_lines", F.col("conflicts").alias("n_conflicts"), "text")
    # At most three runs of a block of 2,048 record numbers are at its ends.
    w = W.partitionBy("game_id").orderBy("block", "run")
    e = runs.where("edge").withColumn("who", F.last("name", True).over(w.rowsBetween(W.unboundedPreceding, 0)))
    e = e.withColumn("prev", F.lag(F.struct("block", "run", "who")).over(w))
    starts = F.col("prev").isNull() | ~F.col("who").eqNullSafe(F.col("prev.who")) | ((F.col("prev.block") == F.col("block")) & (F.col("run") > F.col("prev.run") + 1))
    e = e.withColumn("turn", F.sum(starts.cast("int")).over(w)).where("who is not null")
    part = F.struct("block", "run", "first", "last", "text")
    joined = e.groupBy("game_id", "turn", "who").agg(F.min(part).alias("a"), F.max(part).alias("z"), F.sum("n_lines").alias("n_lines"), F.sum("conflicts").alias("n_conflicts"), F.array_sort(F.collect_list(F.struct("block", "run", "text"))).alias("t"))
    edge = joined.select(
        "game_id", F.col("a.first").alias("first_line_id"), F.col("z.last").alias("last_line_id"), F.col("who").alias("speaker"), "n_lines", "n_conflicts",
        F.array_join(F.filter(F.col("t.text"), lambda s: s != ""), " ").alias("text"),
    )
    return inner.unionByName(edge)
