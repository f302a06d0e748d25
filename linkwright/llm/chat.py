"""Chat formatting: roles from speaker markers and line features by a hidden Markov model, then canonical turns.

The hidden state of a line is its speaker and whether the line opens a turn. What is seen of it is the kind of speaker
marker at its start, if any, and features of the line and the one before. Viterbi decoding gives the likeliest
states of all lines together, so that a line without a marker, or a word that only looks like one, is read in context.

A transcript may be one text (format_chats) or ordered turns of a table (pieces_of, format_pieces). The latter are cut into
pieces of bounded size, whatever a conversation holds. Viterbi is a product of matrices in which sums are maxima and products
are sums: pieces give their matrices, a fold of those gives the scores before each piece, pieces then give which state before them
each last state came from, and a fold backward gives the last states. Log probabilities are integers, so that the
states are those of decoding the whole, ties included.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpoint, modest_batches, table

ROLES = ("system", "user", "assistant")
#: Names that mark a speaker, by role.
NAMES = {"system": ("system", "instructions", "developer"), "user": ("user", "human", "customer", "question", "q", "prompter", "me"), "assistant": ("assistant", "ai", "bot", "gpt", "model", "answer", "a", "agent")}
_ROLE_OF = {name: k for k, role in enumerate(ROLES) for name in NAMES[role]}
_ANY = "|".join(sorted(_ROLE_OF, key=len, reverse=True))
_MARKERS = (re.compile(rf"\s*(?:\*\*|#+\s*)?({_ANY})(?:\*\*)?\s*(?::|>)(?:\*\*)?\s*", re.I), re.compile(rf"\s*<\|?(?:im_start\|>)?({_ANY})\|?>\s*", re.I), re.compile(rf"\s*\[({_ANY})\]:?\s*", re.I))
_END = re.compile(r"\s*(?:<\|(?:im_)?end\|>|</(?:user|assistant|system)>)\s*$", re.I)
#: Turns and characters of a piece, beyond its last turn. States don't depend on them.
PIECE_TURNS, PIECE_CHARS = 4096, 4 << 20


@dataclass(frozen=True)
class Tables:
    """Log probabilities of the model. States 0-2 open a turn of a role, 3-5 continue it.

    mark: of a marker of the state's role, of another role, of none; yes and no: of the features of a line.
    """

    start: np.ndarray
    move: np.ndarray
    mark: np.ndarray
    yes: np.ndarray
    no: np.ndarray

    def fixed(self) -> Tables:
        """These tables as integers, in units of 2**-24: sums don't depend on their order."""
        return Tables(*[np.round(x * (1 << 24)).astype(np.int64) for x in (self.start, self.move, self.mark, self.yes, self.no)])


#: Features of a line, in this order: behind a blank line, ends with '?', more than 200 characters, starts like code or a list, blank.
FEATURES = 5
#: How often start, transition, marker kind and feature are seen with each state, in one vector of counts.
_SHAPES = {"start": (6,), "move": (6, 6), "mark": (6, 3), "yes": (6, FEATURES), "lines": (6,)}
_SIZES = [int(np.prod(s)) for s in _SHAPES.values()]


def tables_of(counts: np.ndarray, prior: float = 0.5) -> Tables:
    """Tables from counts, each with ``prior`` added; without counts all states are alike but for what markers say."""
    parts = dict(zip(_SHAPES, np.split(counts.astype(float), np.cumsum(_SIZES)[:-1]), strict=True))
    start, move, mark, yes, lines = (parts[k].reshape(s) for k, s in _SHAPES.items())
    share = lambda x: np.log((x + prior) / (x + prior).sum(axis=-1, keepdims=True))
    told = (yes + prior) / (lines[:, None] + 2 * prior)
    return Tables(share(start), share(move), share(mark + _BELIEF), np.log(told), np.log(1 - told))


#: What markers say before anything is seen: one line's worth.
_BELIEF = np.array([[0.8, 0.01, 0.19]] * 3 + [[0.01, 0.01, 0.98]] * 3)
_CODE = re.compile(r"\s*(?:[-*•]\s|\d+[.)]\s|```|    |\t|def |class |import )")


def marker_of(line: str) -> tuple[int, int]:
    """(role number or -1, length of the marker) at the start of a line."""
    for pattern in _MARKERS:
        if m := pattern.match(line):
            return _ROLE_OF[m[1].lower()], m.end()
    return -1, 0


def observed(lines: list[str], behind: bool = False) -> tuple[np.ndarray, np.ndarray, list[tuple[int, int]]]:
    """(features, kind of marker by state, markers) of lines; behind: whether a blank line stands before them."""
    marks = [marker_of(x) for x in lines]
    seen = np.array([[not lines[k - 1].strip() if k else behind, x.rstrip().endswith("?"), len(x) > 200, bool(_CODE.match(x)), not x.strip()] for k, x in enumerate(lines)], np.int64)
    role = np.array([m[0] for m in marks])[:, None]
    kind = np.where(role < 0, 2, np.where(role == np.arange(6) % 3, 0, 1))
    return seen, kind, marks


def emissions(lines: list[str], tables: Tables, behind: bool = False) -> tuple[np.ndarray, list[tuple[int, int]]]:
    seen, kind, marks = observed(lines, behind)
    return seen @ tables.yes.T + (1 - seen) @ tables.no.T + tables.mark[np.arange(6)[None, :], kind], marks


def best_paths(logs: list[np.ndarray], first: list[np.ndarray], move: np.ndarray, last: list[int] | None = None) -> list[np.ndarray]:
    """The likeliest states of many sequences at once; ties fall to the smaller state.

    first: the scores of the states of a sequence's first line, what it shows left out. last: each sequence's last state, or
    -1 for the best. Sequences go through together, the longest first, so that those of a step are the first few.
    """
    order = sorted(range(len(logs)), key=lambda k: -len(logs[k]))
    lengths = np.array([len(logs[k]) for k in order])
    if not len(lengths):
        return []
    active = [int(n) for n in np.searchsorted(-lengths, -np.arange(lengths[0]), side="left")]
    flat, starts = np.concatenate([logs[k] for k in order]), np.concatenate([[0], np.cumsum(lengths)[:-1]])
    best = np.array([first[k] for k in order]) + flat[starts]
    back = [np.empty(0, np.int8)]
    for t in range(1, lengths[0]):
        n = active[t]
        ways = best[:n, :, None] + move
        back.append(ways.argmax(axis=1).astype(np.int8))
        best[:n] = ways.max(axis=1) + flat[starts[:n] + t]
    state = best.argmax(axis=1)
    if last is not None:
        wanted = np.array([last[k] for k in order])
        state = np.where(wanted >= 0, wanted, state)
    path = np.empty(len(flat), np.int64)
    for t in range(lengths[0] - 1, -1, -1):
        n = active[t]
        path[starts[:n] + t] = state[:n]
        if t:
            state[:n] = back[t][np.arange(n), state[:n]]
    out: list[np.ndarray] = [path] * len(logs)
    for k, at, n in zip(order, starts.tolist(), lengths.tolist(), strict=True):
        out[k] = path[at : at + n]
    return out


def viterbi(logs: np.ndarray, tables: Tables) -> np.ndarray:
    """The likeliest states of one sequence."""
    return best_paths([logs], [tables.start], tables.move)[0]


def transfer(logs: np.ndarray, first: np.ndarray, move: np.ndarray) -> np.ndarray:
    """Best scores of the last states for each row of first: scores of the states of the first line, what it shows left out."""
    best = first + logs[0]
    for row in logs[1:]:
        best = (best[:, :, None] + move).max(axis=1) + row
    return best


def came_from(logs: np.ndarray, before: np.ndarray, move: np.ndarray) -> np.ndarray:
    """For each last state, the state before the first line on its best path; before: scores of those states."""
    ways = before[:, None] + move
    source, best = ways.argmax(axis=0), ways.max(axis=0) + logs[0]
    for row in logs[1:]:
        ways = best[:, None] + move
        source, best = source[ways.argmax(axis=0)], ways.max(axis=0) + row
    return source


def lines_of(transcript: str) -> list[str]:
    return re.split(r"\r\n|\r|\n", transcript)


def _goes_on(state: int) -> int:
    """The state of a line that goes on with the turn of a line in this state."""
    return state % 3 + 3 if state >= 0 else -1


def states_of(turns: list[tuple[str | None, str]], before: int = -1) -> tuple[list[str], list[int]]:
    """Lines of turns as they were written, and their states; before: the state of the line before them, -1 if none is known.

    A turn's first line that isn't blank opens it, what is blank before it goes on with the turn before.
    """
    lines, states = [], []
    for role, text in turns:
        number, opened = ROLES.index(role) if role in ROLES else -1, False
        for line in lines_of(text):
            lines.append(line)
            if not opened and line.strip():
                before, opened = number, True
            else:
                before = -1 if number < 0 else number + 3 if opened else _goes_on(before)
            states.append(before)
    return lines, states


def counted(turns: list[tuple[str | None, str]], first: bool = True, before: int = -1, behind: bool = False) -> np.ndarray:
    """Counts of one transcript, written as these (role, text) with markers and blank lines, with the states of its lines.

    Turns without a known role teach nothing, nor does the step to the turn behind them. A transcript's later piece isn't
    first: before is the state of the line before it, behind tells whether that is blank.
    """
    lines, states = states_of(turns, before)
    counts = {k: np.zeros(s) for k, s in _SHAPES.items()}
    if lines:
        seen, kind, _ = observed(lines, behind)
        state = np.array(states)
        known = np.flatnonzero(state >= 0)
        if first and state[0] >= 0:
            counts["start"][state[0]] += 1
        old = np.concatenate([[-1 if first else before], state[:-1]])
        both = np.flatnonzero((state >= 0) & (old >= 0))
        np.add.at(counts["move"], (old[both], state[both]), 1)
        np.add.at(counts["mark"], (state[known], kind[known, state[known]]), 1)
        np.add.at(counts["yes"], state[known], seen[known])
        np.add.at(counts["lines"], state[known], 1)
    return np.concatenate([counts[k].ravel() for k in _SHAPES])


def fit(pieces: DataFrame) -> Tables:
    """Tables from pieces of transcripts (pieces_of); counts of all rows, summed in the cluster."""

    def count(batches):
        total = np.zeros(sum(_SIZES))
        for t in batches:
            for roles, texts, first, before, behind in zip(t.roles, t.lines, t["first"], t.before, t.behind, strict=True):
                total += counted(list(zip(roles, texts, strict=True)), bool(first), int(before), bool(behind))
        yield pd.DataFrame({"place": np.arange(len(total)), "n": total})

    sums = pieces.select("roles", "lines", "first", "before", "behind").mapInPandas(count, "place long, n double").groupBy("place").agg(F.sum("n").alias("n")).toPandas()
    return tables_of(np.bincount(sums.place.to_numpy(np.int64), sums.n.to_numpy(float), sum(_SIZES)))


def spoken(states: np.ndarray, lines: list[str], marks: list[tuple[int, int]], last: int = -1) -> Iterator[tuple[int, bool, str]]:
    """(role, opens a turn, text without its marker) of lines; last: the role of the line before them, -1 if there is none."""
    for state, line, (role, width) in zip(states.tolist(), lines, marks, strict=True):
        opens = state < 3 or last != state % 3
        last = state % 3
        yield last, opens, _END.sub("", line[width:] if opens and role == last else line)


def turns_of(told: Iterator[tuple[int, bool, str]]) -> list[tuple[str, str]]:
    """(role, text) of turns; those without text are dropped."""
    turns: list[tuple[int, list[str]]] = []
    for role, opens, text in told:
        if opens:
            turns.append((role, [text]))
        else:
            turns[-1][1].append(text)
    return [(ROLES[r], body) for r, body in ((r, "\n".join(x).strip()) for r, x in turns) if body]


def parse_many(transcripts: list[str | None], tables: Tables | None = None) -> list[list[tuple[str, str]]]:
    """(role, text) of the turns of each transcript. A null or blank one has none; turns without text are dropped."""
    tables = (tables or USUAL).fixed()
    texts = [(k, lines_of(x)) for k, x in enumerate(transcripts) if x and x.strip()]
    seen = [emissions(lines, tables) for _, lines in texts]
    paths = best_paths([logs for logs, _ in seen], [tables.start] * len(seen), tables.move)
    out: list[list[tuple[str, str]]] = [[] for _ in transcripts]
    for (k, lines), (_, marks), path in zip(texts, seen, paths, strict=True):
        out[k] = turns_of(spoken(path, lines, marks))
    return out


def parse(transcript: str | None, tables: Tables | None = None) -> list[tuple[str, str]]:
    return parse_many([transcript], tables)[0]


def render(turns: list[tuple[str, str]]) -> str:
    """Canonical form of turns; neighbours of one role become one turn."""
    joined: list[list[str]] = []
    for role, text in turns:
        if joined and joined[-1][0] == role:
            joined[-1][1] += "\n" + text
        else:
            joined.append([role, text])
    return "".join(f"<|{role}|>\n{text}\n<|end|>\n" for role, text in joined)


#: Tables for transcripts of unknown making: counts of a few small talks in common styles.
USUAL = tables_of(
    sum(
        5 * counted(x)
        for x in (
            [("system", "System: Be brief."), ("user", "\nUser: Hello there"), ("assistant", "\nAssistant: Hello.\nHow can I help?"), ("user", "\nhow do I sort a list?"), ("assistant", "\nAssistant: Like this:\n- one\n- two\nand so on.")],
            [("user", "<|user|>\nwhat is it?"), ("assistant", "<|assistant|>\nA test.\n\nIt has two parts.")],
            [("user", "Human: hi"), ("assistant", "AI: hello"), ("user", "Human: why?"), ("assistant", "AI: because")],
        )
    )
)


def format_chats(transcripts: DataFrame, tables: Tables | None = None) -> DataFrame:
    """Adds turns (array of role, text) and rendered to rows with a column transcript.

    Columns that were named turns or rendered are replaced, all others stay. Null and blank transcripts have no turns and
    render as an empty text; repeated rows get equal results; a long transcript is decoded whole, in one row.
    """

    @F.pandas_udf("turns array<struct<role:string,text:string>>, rendered string")
    def formatted(texts: pd.Series) -> pd.DataFrame:
        turns = parse_many(texts.tolist(), tables)
        return pd.DataFrame({"turns": [[{"role": r, "text": x} for r, x in t] for t in turns], "rendered": [render(t) for t in turns]})

    others = {f"__other_{i}": c for i, c in enumerate(transcripts.columns) if c not in ("turns", "rendered")}
    inner = modest_batches(transcripts).select(*[F.col(f"`{c}`").alias(n) for n, c in others.items()], formatted(F.col("transcript").cast("string")).alias("__chat"))
    return inner.select(*[F.col(n).alias(c) for n, c in others.items()], "__chat.turns", "__chat.rendered")


#: How transcripts are written: how a marker follows its role, what stands between turns, and what makes it harder.
STYLES = ("colon", "tags", "headings", "paragraphs", "look-alikes")


def written_turns(conversations: DataFrame) -> DataFrame:
    """(conv, style, turn, role, text, shown, line) from rows (conv_id, turn, role, text); conv is conv_id as text.

    Each turn bears its role's marker in line, in one of STYLES by conv_id, as exports of chats do; one in seven has lost
    it. Only headings and paragraphs have a blank line between turns; paragraphs have them inside turns too; look-alikes
    have lines in turns of users that look like an assistant's marker. Null texts are empty, null roles have no marker.
    """
    style = F.pmod(F.xxhash64("conv_id"), F.lit(len(STYLES))).cast("int")
    role, text = F.col("role"), F.coalesce("text", F.lit(""))
    chance = lambda n, k: F.pmod(F.xxhash64("conv_id", "turn", "text", F.lit(k)), F.lit(n)) == 0
    colon = F.concat(F.initcap(role), F.lit(": "))
    marker = F.when(style == 1, F.concat(F.lit("<|"), role, F.lit("|>\n"))).when(style == 2, F.concat(F.lit("### "), F.when(role == "user", "Human").otherwise(F.initcap(role)), F.lit(":\n")))
    marker = marker.when(style == 4, F.when(role == "user", "Q: ").when(role == "assistant", "A: ").otherwise(colon)).otherwise(colon)
    lost = chance(7, 0) & (F.col("turn") > 0)
    shown = F.when(style == 3, F.regexp_replace(text, r"([.?!]) ", "$1\n\n")).when((style == 4) & (role == "user") & chance(5, 1), F.concat(text, F.lit("\nanswer: in one line"))).otherwise(text)
    line = F.concat(F.when((style == 2) | (style == 3), F.when(F.col("turn") > 0, "\n").otherwise("")).otherwise(""), F.when(lost | role.isNull(), F.lit("")).otherwise(marker), shown)
    return conversations.select(F.col("conv_id").cast("string").alias("conv"), style.alias("style"), "turn", "role", shown.alias("shown"), line.alias("line"))


_PIECE = "part long, no long, conv string, style int, roles array<string>, lines array<string>, texts array<string>"
_EDGES = "head boolean, tail boolean, first boolean, last boolean, before int, behind boolean, loose boolean, after int, inherits boolean, blank boolean"


def pieces_of(turns: DataFrame) -> DataFrame:
    """Conversations cut into pieces of at most PIECE_TURNS turns and PIECE_CHARS characters (or one turn), in order.

    Turns stand in the order of turn (null first), then role, then a hash of the line. part and no order the pieces. Sorting deals a
    large conversation, and repeated rows, to many tasks. A piece knows the state (before) and blankness (behind) of the line
    before it; where that lies in another task, it comes from a table with one row for the first and last piece of
    each task, which alone goes through the driver.
    """

    def cut(batches):
        part, no, held, chars = TaskContext.get().partitionId(), 0, [], 0
        conv = style = None
        # whether the piece opens a conversation, the state and blankness of the line before it, and whether that state
        # is what another task ends with
        first, before, behind, loose = False, -1, False, True

        def piece(last, tail):
            nonlocal no, held, chars, first, before, behind, loose
            written = [(r, x) for r, x, _ in held]
            lines, states = states_of(written, before)
            inherits, blank = loose and states_of(written, 0)[1][-1] != states[-1], not lines[-1].strip()
            row = (part, no, conv, style, *[[x[k] for x in held] for k in range(3)], no == 0, tail, first, last, before, behind, loose, states[-1], inherits, blank)
            no, held, chars = no + 1, [], 0
            first, before, behind, loose = last, -1 if last else states[-1], blank and not last, inherits and not last
            return row

        for t in batches:
            rows = []
            for c, k, role, line, shown in zip(t.conv.tolist(), t["style"].tolist(), t.role.tolist(), t.line.tolist(), t.shown.tolist(), strict=True):
                c, role = (x if isinstance(x, str) else None for x in (c, role))
                if held and (c != conv or len(held) >= PIECE_TURNS or chars + len(line) > PIECE_CHARS):
                    rows.append(piece(c != conv, False))
                conv, style = c, k
                held.append((role, line, shown))
                chars += len(line)
            if rows:
                yield pd.DataFrame(rows, columns=_NAMES)
        if held:
            yield pd.DataFrame([piece(False, True)], columns=_NAMES)

    ordered = modest_batches(turns).orderBy(*[F.col(c).asc_nulls_first() for c in ("conv", "turn", "role")], F.xxhash64("line"), F.monotonically_increasing_id())
    pieces = checkpoint(ordered.select("conv", "style", "role", "line", "shown").mapInPandas(cut, f"{_PIECE}, {_EDGES}"))
    edges, told = pieces.filter("head or tail").select("part", "no", "conv", "head", "tail", "after", "inherits", "blank").orderBy("part", "no").collect(), []
    end = (-1, False)
    for k, e in enumerate(edges):
        if e["head"]:
            follows = k > 0 and edges[k - 1]["conv"] == e["conv"]
            told.append([e["part"], not follows, *(end if follows else (-1, False)), True])
        if e["tail"]:
            told[-1][4] = k + 1 == len(edges) or edges[k + 1]["conv"] != e["conv"]
            start = told[-1][2]
            end = (_goes_on(start) if e["inherits"] else e["after"], e["blank"])
    known = F.broadcast(turns.sparkSession.createDataFrame([tuple(x) for x in told], "part long, __first boolean, __before int, __behind boolean, __last boolean"))
    at_head = lambda c: F.when(F.col("head"), F.col(f"__{c}")).otherwise(F.col(c))
    loose = F.col("loose") & ~F.col("head")
    before = F.when(loose & (F.col("__before") >= 0), F.col("__before") % 3 + 3).otherwise(at_head("before"))
    return pieces.join(known, "part").select("part", "no", "conv", "style", "roles", "lines", "texts", at_head("first").alias("first"), before.alias("before"), at_head("behind").alias("behind"), F.when(F.col("tail"), F.col("__last")).otherwise(F.col("last")).alias("last"))


_NAMES = [x.split()[0] for x in f"{_PIECE}, {_EDGES}".split(", ")]
_SCORES = "part long, no long, conv string, last boolean"


def _piece_lines(lines) -> list[str]:
    return [x for line in lines for x in lines_of(line)]


def ends_of(pieces: DataFrame, tables: Tables) -> DataFrame:
    """(part, no, scores, entry, end): scores of the states before a piece, the state before it and its last state, as
    decoding the whole would have them. Only pieces of transcripts that have several; from one piece a fold takes 36 numbers."""
    fixed = tables.fixed()

    def seen(t):
        for k, row in t.iterrows():
            yield k, row, emissions(_piece_lines(row["lines"]), fixed, bool(row["behind"]))[0]

    def matrices(batches):
        for t in batches:
            found = [transfer(logs, np.broadcast_to(fixed.start, (6, 6)) if row["first"] else fixed.move, fixed.move) for _, row, logs in seen(t)]
            yield t[["part", "no", "conv", "last"]].assign(matrix=[(m - m.max()).ravel().tolist() for m in found])

    def forward(t: pd.DataFrame) -> pd.DataFrame:
        t = t.sort_values(["part", "no"], ignore_index=True)
        scores, out = np.zeros(6, np.int64), []
        for m in t.matrix:
            out.append(scores.tolist())
            scores = (scores[:, None] + np.asarray(m, np.int64).reshape(6, 6)).max(axis=0)
            scores = scores - scores.max()
        return pd.DataFrame({"part": t.part, "no": t.no, "scores": out, "best": scores.argmax()})

    def sources(batches):
        for t in batches:
            found = [came_from(logs, np.asarray(row["scores"], np.int64), fixed.move) for _, row, logs in seen(t)]
            yield t[["part", "no", "conv", "last", "scores", "best"]].assign(source=[x.tolist() for x in found])

    def backward(t: pd.DataFrame) -> pd.DataFrame:
        t = t.sort_values(["part", "no"], ignore_index=True)
        end, ends, entries = int(t.best.iloc[-1]), [], []
        for source in t.source[::-1]:
            ends.append(end)
            end = int(source[end])
            entries.append(end)
        return pd.DataFrame({"part": t.part, "no": t.no, "scores": t.scores, "entry": entries[::-1], "end": ends[::-1]})

    some = pieces.filter("not (first and last)").select("part", "no", "conv", "lines", "first", "last", "behind")
    folded = some.mapInPandas(matrices, f"{_SCORES}, matrix array<long>").groupBy("conv").applyInPandas(forward, "part long, no long, scores array<long>, best int")
    ways = some.join(checkpoint(folded), ["part", "no"]).mapInPandas(sources, f"{_SCORES}, scores array<long>, best int, source array<int>")
    return checkpoint(ways.groupBy("conv").applyInPandas(backward, "part long, no long, scores array<long>, entry int, end int"))


class Canon:
    """Canonical text of one conversation, streamed into a digest: only the turn that is open is held."""

    def __init__(self) -> None:
        self.digest, self.roles, self.role, self.parts, self.open = hashlib.sha256(), [], -1, [], None

    def close(self) -> None:
        if self.parts and (body := "\n".join(self.parts).strip()):
            role = ROLES[self.role]
            self.digest.update(("\n" if role == self.open else f"{self.tail()}<|{role}|>\n").encode() + body.encode("utf-8", "surrogatepass"))
            self.roles.append(role)
            self.open = role
        self.parts = []

    def tail(self) -> str:
        return "" if self.open is None else "\n<|end|>\n"

    def add(self, role: int, opens: bool, text: str) -> None:
        if opens:
            self.close()
            self.role = role
        self.parts.append(text)

    def done(self) -> str:
        self.close()
        self.digest.update(self.tail().encode())
        return self.digest.hexdigest()


_FORMATTED = "conv string, style int, n_written long, n_turns long, roles_found string, roles_written string, rendered_sha256 string, written_sha256 string"


def format_pieces(pieces: DataFrame, tables: Tables) -> DataFrame:
    """A row of each conversation: turns written and found, their roles, and digests of the canonical turns, found and written.

    Conversations in one piece are decoded where they lie, many at once. Of others, pieces are decoded each by itself from
    what ends_of gives, and their turns pass in order through one task of the conversation, which streams them into digests.
    """
    fixed = tables.fixed()

    def decode(batches):
        for t in batches:
            lines = [_piece_lines(x) for x in t.lines]
            seen = [emissions(x, fixed, bool(b)) for x, b in zip(lines, t.behind, strict=True)]
            alone = "end" not in t
            starts = [fixed.start if f else (np.asarray(t.scores[k], np.int64)[:, None] + fixed.move).max(axis=0) for k, f in enumerate(t["first"])]
            paths = best_paths([x for x, _ in seen], starts, fixed.move, None if alone else t["end"].tolist())
            told = [list(spoken(p, x, m, -1 if f else int(t.entry[k]) % 3)) for k, (p, x, (_, m), f) in enumerate(zip(paths, lines, seen, t["first"], strict=True))]
            out = t[["part", "no", "conv", "style", "roles", "texts", "first", "last"]].copy()
            yield out.assign(said=[[x[0] for x in s] for s in told], opens=[[x[1] for x in s] for s in told], bare=[[x[2] for x in s] for s in told])

    def stream(batches):
        found = written = roles = None
        for t in batches:
            rows = []
            for k in range(len(t)):
                if t["first"][k]:
                    found, written, roles = Canon(), Canon(), []
                for role, opens, text in zip(t.said[k], t.opens[k], t.bare[k], strict=True):
                    found.add(int(role), bool(opens), text)
                for role, text in zip(t.roles[k], t.texts[k], strict=True):
                    roles.append(role or "?")
                    if role in ROLES:
                        written.add(ROLES.index(role), True, text)
                if t["last"][k]:
                    digests = found.done(), written.done()
                    rows.append((t.conv[k], t["style"][k], len(roles), len(found.roles), " ".join(found.roles), " ".join(roles), *digests))
            yield pd.DataFrame(rows, columns=[x.split()[0] for x in _FORMATTED.split(", ")])

    told = "part long, no long, conv string, style int, roles array<string>, texts array<string>, first boolean, last boolean, said array<int>, opens array<boolean>, bare array<string>"
    whole = pieces.filter("first and last").mapInPandas(decode, told).mapInPandas(stream, _FORMATTED)
    some = pieces.filter("not (first and last)").join(ends_of(pieces, tables), ["part", "no"]).mapInPandas(decode, told)
    return whole.unionByName(some.repartition("conv").sortWithinPartitions("conv", "part", "no").mapInPandas(stream, _FORMATTED))


def held_out(column: str) -> Column:
    """Conversations that don't teach: crc32 of the id as text leaves 1 by 3."""
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def op6_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row of each conversation with the roles written and found, and digests of the canonical turns.

    The tables are fitted on conversations that aren't held out. written_sha256 is of the turns as they were written. Rows
    with a null conv_id are one conversation; null turns come first; null texts are empty; null roles are `?`; repeated rows
    count each; an empty table has no rows.
    """
    chats = table(spark, sf_dir, "conversations")
    kind = chats.schema["conv_id"].dataType
    pieces = pieces_of(written_turns(chats.select("conv_id", "turn", "role", "text")))
    out = format_pieces(pieces, fit(pieces.filter(~held_out("conv"))))
    styles = F.array(*[F.lit(x) for x in STYLES])
    return out.select(
        F.col("conv").cast(kind).alias("conv_id"), F.element_at(styles, F.col("style") + 1).alias("style"), held_out("conv").alias("held_out"), "n_written", "n_turns", "roles_found", "roles_written", "rendered_sha256", "written_sha256",
    )
