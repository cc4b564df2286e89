"""Spelling variants: words one edit apart, found by composing the vocabulary's acceptor with a one-edit transducer and itself.

The composed machine accepts the pairs of words of which one becomes the other when one code point is inserted, deleted
or replaced. Until the edit both words are in the same state of the acceptor, so a state stands for all pairs that share
its prefix, and the machine's work is dealt out by such initial states: a state whose words have at most LEAF code
points together is one task's group, which builds the minimal acceptor of what follows the prefix, composes and
enumerates. A state with more words is an upper state: edits at its branching are met by Spark, which brings together
what has to be equal after the edit (the intersection of the right languages), and its successors are initial states
in turn. States between branchings, where all words go on alike, hold no edit and are skipped. A pair is found where its
two words first differ, once. No group holds more than LEAF code points or one variant a code point of the alphabet.

Of each word's near words only their number and the most frequent one are kept, so pairs are never listed.

Defined cases: null, empty and wordless texts have no words; repeated rows count again; a null doc_id counts as an empty one in
the checksum; words of any length are whole; of equally frequent near words the smallest in code-point order is the form; an
empty table gives an empty result; columns other than doc_id and text are never read.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from treeline.llm.common import written
from treeline.llm.urls import LOWER, UPPER

#: Letters of a run, code points of a word and occurrences that a word needs; every EVERYth run by checksum loses a code point.
LETTERS, SHORTEST, SELDOM, EVERY = "A-Za-zÀ-ÿ", 7, 2, 31

#: A form is so many times as frequent as its variant.
TIMES = 10

#: Code points of the words that one task composes together.
LEAF = 20_000


def lowered(run: Column) -> Column:
    """A to Z as a to z, other letters as they are."""
    return F.when(F.lower(run) == run, run).otherwise(F.translate(run, UPPER, LOWER))


def vocabulary(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text) -> word, n: its occurrences."""
    # Runs that are shorter than a word stay shorter; the pattern's matches are whole runs, as it takes all that follows.
    runs = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc"), F.explode(F.regexp_extract_all(F.col("text"), F.lit(f"[{LETTERS}]{{{SHORTEST},}}"), F.lit(0))).alias("run"))
    rows = runs.select("doc", lowered(F.col("run")).alias("run"))
    rows = rows.withColumn("h", F.crc32(F.concat("doc", F.lit(":"), "run").cast("binary")))
    rows = rows.withColumn("at", (F.col("h") % F.length("run")).cast("int"))
    cut = F.concat(F.expr("substring(run, 1, at)"), F.expr("substring(run, at + 2)"))
    word = F.when(F.col("h") % EVERY == 0, cut).otherwise(F.col("run"))
    return rows.select(word.alias("word")).filter(F.length("word") >= SHORTEST).groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= SELDOM)


# --- one group: acceptor, transducer, composition ---------------------------------------------------------------------


class Acceptor:
    """The minimal acyclic automaton of some words, given in code-point order: arcs and finality of its states."""

    def __init__(self, words: list[str]):
        self.arcs: list[dict[str, int]] = []
        self.final: list[bool] = []
        known: dict[tuple, int] = {}
        path: list[tuple[dict[str, int], list[bool]]] = [({}, [False])]
        before = ""

        def settle(keep: int) -> int:
            """Gives the states of the last word, beyond the first `keep` letters, their numbers; equal states share one."""
            while True:
                arcs, final = path[-1]
                key = (final[0], *arcs.items())
                if key not in known:
                    known[key] = len(self.arcs)
                    self.arcs.append(arcs)
                    self.final.append(final[0])
                path.pop()
                if not path:
                    return known[key]
                path[-1][0][before[len(path) - 1]] = known[key]
                if len(path) == keep + 1:
                    return known[key]

        for word in words:
            shared = next((i for i, (a, b) in enumerate(zip(before, word, strict=False)) if a != b), min(len(before), len(word)))
            if len(path) > shared + 1:
                settle(shared)
            path.extend(({}, [False]) for _ in word[shared:])
            path[-1][1][0] = True
            before = word
        self.start = settle(-1)


#: The one-edit transducer. State 0: nothing is edited yet; state 1, which accepts: the edit is done. Pairs are unordered, so
#: an insertion is a deletion read the other way.
BEFORE, DONE = 0, 1


class Composition:
    """Acceptor, transducer, acceptor: states are (left, transducer, right)."""

    def __init__(self, acceptor: Acceptor):
        self.arcs, self.final, self.start = acceptor.arcs, acceptor.final, acceptor.start
        self.meet: dict[tuple[int, int], bool] = {}

    def alive(self, left: int, right: int) -> bool:
        """Whether some word goes on from both states: whether (left, DONE, right) leads to an accepting state."""
        if left == right:
            return True
        if (left, right) in self.meet:
            return self.meet[left, right]
        todo = [(left, right)]
        while todo:
            q, r = todo[-1]
            verdict: bool | None = self.final[q] and self.final[r]
            if not verdict:
                for c, q2 in self.arcs[q].items():
                    if (r2 := self.arcs[r].get(c)) is None:
                        continue
                    known = True if q2 == r2 else self.meet.get((q2, r2))
                    if known is None:
                        todo.append((q2, r2))
                        verdict = None
                        break
                    if known:
                        verdict = True
                        break
            if verdict is not None:
                self.meet[q, r] = verdict
                todo.pop()
        return self.meet[left, right]

    def pairs(self) -> Iterator[tuple[str, str]]:
        """Each accepted pair once."""
        todo = [(self.start, BEFORE, self.start, "", "")]
        while todo:
            q, state, r, u, v = todo.pop()
            if state == DONE:
                if self.final[q] and self.final[r]:
                    yield u, v
                for c, q2 in self.arcs[q].items():
                    if (r2 := self.arcs[r].get(c)) is not None and self.alive(q2, r2):
                        todo.append((q2, DONE, r2, u + c, v + c))
                continue
            arcs = list(self.arcs[q].items())
            for i, (c, q1) in enumerate(arcs):
                todo.append((q1, BEFORE, q1, u + c, u + c))
                for d, q2 in arcs[i + 1 :]:
                    if self.alive(q1, q2):  # c is replaced by d
                        todo.append((q1, DONE, q2, u + c, u + d))
                # c is deleted; the other word must not go on with c, or the two would differ later only
                if self.final[q1] and self.final[q]:
                    yield u + c, u
                for d, q2 in arcs:
                    if d != c and (q3 := self.arcs[q1].get(d)) is not None and self.alive(q3, q2):
                        todo.append((q3, DONE, q2, u + c + d, u + d))


def near_words(words: dict[str, int], prefix: str) -> dict[str, tuple[int, int, str]]:
    """Words that all begin with prefix, with their occurrences -> for each that has near words: their number, the occurrences of the most frequent and that word."""
    found: dict[str, tuple[int, int, str]] = {}
    machine = Composition(Acceptor([w[len(prefix) :] for w in sorted(words)]))
    for x, y in machine.pairs():
        u, v = prefix + x, prefix + y
        for one, other in ((u, v), (v, u)):
            near, n, form = found.get(one, (0, 0, ""))
            better = words[other] > n or words[other] == n and other < form
            found[one] = (near + 1, *((words[other], other) if better else (n, form)))
    return found


# --- all groups -------------------------------------------------------------------------------------------------------

NEAR = "word string, near long, form_n long, form string"


def shared_length(a: Column, b: Column) -> Column:
    """Code points that two strings begin with alike; the longer one of two that agree goes on."""
    same = F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: x.eqNullSafe(y))
    return F.array_position(same, False).cast("int") - 1


def initial_states(words: DataFrame, leaf: int = LEAF) -> tuple[DataFrame, list[DataFrame]]:
    """words(word, n) -> groups(state, word, n) of at most leaf code points each, and the words of each round's upper states (state, word, n).

    A round takes one branching of every state that is still too large, so there are as many as branchings with over
    leaf code points below them lie on one path.
    """
    waiting = words.select("word", "n", F.lit("").alias("state"))
    groups, upper = [], []
    while True:
        sizes = waiting.groupBy("state").agg(F.sum(F.length("word")).alias("size"), F.count("*").alias("words"), F.min("word").alias("least"), F.max("word").alias("most"))
        sizes = written(sizes.filter("words > 1").select(F.col("state").alias("s_state"), (F.col("size") > leaf).alias("large"), F.when(F.col("size") > leaf, shared_length(F.col("least"), F.col("most"))).alias("branch")), "states")
        joined = waiting.join(sizes, F.col("state") == F.col("s_state"))
        groups.append(joined.filter("not large").select("state", "word", "n"))
        if sizes.filter("large").isEmpty():
            whole = groups[0]
            for g in groups[1:]:
                whole = whole.unionByName(g)
            return whole, upper
        branching = written(joined.filter("large").select(F.expr("substring(word, 1, branch)").alias("state"), "word", "n"), "upper-states")
        upper.append(branching)
        waiting = written(branching.filter("length(word) > length(state)").select("word", "n", F.expr("substring(word, 1, length(state) + 1)").alias("state")), "waiting-words")


def met_at(branching: DataFrame) -> DataFrame:
    """Near words whose first difference is right after an upper state: NEAR's columns.

    A word goes with what follows its next code point, which it may lose or replace, and with all that follows the
    state, into which another word may turn by a loss. Words that go with the same rest are near, but for a loss that
    only moves the difference. At most one word a code point shares a rest.
    """
    own = F.struct("word", "n")
    at = F.length("state")
    lost = branching.filter(F.length("word") > at).select("state", F.expr("substring(word, length(state) + 2)").alias("rest"), F.expr("substring(word, length(state) + 1, 1)").alias("next"), own.alias("w"))
    whole = branching.select("state", F.expr("substring(word, length(state) + 1)").alias("rest"), F.lit("").alias("next"), own.alias("w"))
    groups = lost.unionByName(whole).groupBy("state", "rest").agg(F.collect_list(F.struct("next", "w")).alias("all")).filter(F.size("all") > 1)
    groups = groups.select("all", F.substring("rest", 1, 1).alias("first"), F.explode("all").alias("one"))

    def near(other: Column) -> Column:
        a, b = F.col("one.next"), other["next"]
        # An empty `next` marks the word that stays whole; the other must not lose what that one goes on with.
        moved = ((a == "") & (b == F.col("first"))) | ((b == "") & (a == F.col("first")))
        return (a != b) & ~(moved & (F.col("first") != ""))

    others = F.transform(F.filter("all", near), lambda x: F.struct((-x["w"]["n"]).alias("n"), x["w"]["word"].alias("word")))
    rows = groups.select(F.col("one.w.word").alias("word"), F.size(others).cast("long").alias("near"), F.array_min(others).alias("best")).filter("near > 0")
    return rows.select("word", "near", (-F.col("best.n")).alias("form_n"), F.col("best.word").alias("form"))


def near_table(words: DataFrame, leaf: int = LEAF) -> DataFrame:
    """words(word, n) -> word, near (its near words), form_n and form (the most frequent of them): words that have any."""
    groups, upper = initial_states(words, leaf)
    out = pa.schema([("word", pa.string()), ("near", pa.int64()), ("form_n", pa.int64()), ("form", pa.string())])

    def compose(key, rows):
        found = near_words(dict(zip(rows.column("word").to_pylist(), rows.column("n").to_pylist(), strict=True)), key[0].as_py())
        return pa.table([pa.array(c, f.type) for c, f in zip(zip(*((w, *x) for w, x in found.items()), strict=True), out, strict=True)] if found else [pa.array([], f.type) for f in out], schema=out)

    parts = groups.groupBy("state").applyInArrow(compose, NEAR)
    for branching in upper:
        parts = parts.unionByName(met_at(branching))
    best = F.min(F.struct((-F.col("form_n")).alias("n"), F.col("form").alias("form")))
    rows = parts.groupBy("word").agg(F.sum("near").alias("near"), best.alias("best"))
    return rows.select("word", "near", (-F.col("best.n")).alias("form_n"), F.col("best.form").alias("form"))


def rooted(forms: DataFrame) -> DataFrame:
    """forms(word, form) -> word, root: the last word that forms lead to. Each round doubles the steps that are taken."""
    roots = written(forms.select("word", F.col("form").alias("root")), "variant-roots")
    while True:
        next_root = roots.select(F.col("word").alias("f_word"), F.col("root").alias("f_root"))
        further = written(roots.join(next_root, F.col("root") == F.col("f_word"), "left").select("word", F.coalesce("f_root", "root").alias("root"), F.col("f_root").isNotNull().alias("moved")), "variant-roots")
        roots = further.select("word", "root")
        if further.filter("moved").isEmpty():
            return roots


def variants(docs: DataFrame, leaf: int = LEAF) -> DataFrame:
    """docs(doc_id, text) -> word, form, root, n, n_near, form_n: a row a word of the vocabulary."""
    words = written(vocabulary(docs), "vocabulary")
    near = near_table(words, leaf).withColumnRenamed("word", "n_word")
    rows = words.join(near, F.col("word") == F.col("n_word"), "left").drop("n_word")
    often = F.col("form_n") >= TIMES * F.col("n")
    rows = written(rows.select("word", "n", F.coalesce("near", F.lit(0)).cast("long").alias("n_near"), F.when(often, F.col("form")).alias("form"), F.when(often, F.col("form_n")).alias("form_n")), "variants")
    roots = rooted(rows.filter("form is not null").select("word", "form")).withColumnRenamed("word", "r_word")
    return rows.join(roots, F.col("word") == F.col("r_word"), "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
