"""Chinese words of a text by a lexicon, their sounds, and queries in two languages. Lexicons are tables, none is built in."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomquery.functions import lexical as L
from loomquery.functions.text import words as english_words
from loomquery.operators import search

#: Bytes of a lexicon's words that travel to tasks at most, and the least reach of a match.
LEXICON_BYTES, LEAST_REACH = 8 << 20, 4
# Words of a query that ask for tests.
TEST_WORDS, TEST_PATTERN = ["测试", "单测", "基准"], "(?i)test|bench|spec"
_RUN = re.compile("[一-鿿]{2,}")


@dataclass
class Lexicon:
    """``words(word)``, ``stop(word)``, ``typos(typo, word, ordinal)``, ``sounds(char, sound)``, ``synonyms(word, peer, ordinal)`` and
    ``glossary(word, english, place, ordinal)``: the English of a word in order, ``place`` being that of the word."""

    words: DataFrame
    stop: DataFrame
    typos: DataFrame
    sounds: DataFrame
    synonyms: DataFrame
    glossary: DataFrame


@dataclass
class Automaton:
    """What segmentation needs of a lexicon: tries of its words from either end, the longest word, and the other tables as dicts."""

    stop: frozenset
    typos: list
    sounds: dict
    canonical: dict
    known: frozenset
    reach: int
    forward: dict = field(default_factory=dict)
    backward: dict = field(default_factory=dict)

    def __post_init__(self):
        for word in self.known | {w for w in self.stop if len(w) > 1}:
            for trie, chars in ((self.forward, word), (self.backward, word[::-1])):
                for c in chars:
                    trie = trie.setdefault(c, {})
                trie[""] = True

    def sound(self, word: str) -> str | None:
        """The sounds of a word of two characters or more, joined; none if one has none."""
        found = [self.sounds.get(c) for c in word]
        return "".join(found) if len(word) > 1 and all(found) else None

    def right(self, text: str) -> str:
        """``text`` with typos replaced, in their order, and pairs of characters that no lexicon has by the word that sounds like them."""
        for typo, word in self.typos:
            text = text.replace(typo, word)

        def pairs(m):
            run, out, i = m[0], [], 0
            while i < len(run):
                pair = run[i : i + 2]
                same = len(pair) == 2 and (pair in self.known or pair in self.stop)
                like = None if same or len(pair) < 2 else self.canonical.get(self.sound(pair))
                out.append(pair if same else like or run[i])
                i += 2 if same or like else 1
            return "".join(out)

        return _RUN.sub(pairs, text)

    def longest(self, trie: dict, chars: str, i: int) -> int:
        best = 1
        for n in range(min(self.reach, len(chars) - i)):
            trie = trie.get(chars[i + n])
            if trie is None:
                break
            if "" in trie:
                best = n + 1
        return best

    def matched(self, run: str, backward: bool) -> list[str]:
        """Longest matches from one end on."""
        trie, chars, out, i = (self.backward, run[::-1], [], 0) if backward else (self.forward, run, [], 0)
        while i < len(chars):
            n = self.longest(trie, chars, i)
            out.append(chars[i : i + n])
            i += n
        return [w[::-1] for w in reversed(out)] if backward else out

    def segment(self, text: str | None) -> tuple[list[str], list[str]]:
        """(words, phrases): different ones in order. Of the matches from either end those with fewer single characters, from the end in doubt; singles in a row are a word."""
        words, phrases = {}, {}
        for run in _RUN.findall(self.right(text or "")):
            if len(run) > 2 and run not in self.stop:
                phrases[run] = True
            ahead, back = self.matched(run, False), self.matched(run, True)
            singles = lambda tokens: sum(len(t) == 1 for t in tokens)
            held = ""
            for token in [*(back if singles(back) <= singles(ahead) else ahead), None]:
                if token is not None and len(token) == 1 and token not in self.stop:
                    held += token
                    continue
                if len(held) > 1:
                    words[self.canonical.get(self.sound(held), held)] = True
                held = ""
                if token is not None and token not in self.stop:
                    words[token] = True
        return list(words), list(phrases)


def automaton(lexicon: Lexicon) -> Automaton:
    """Gathers a lexicon, which people write, for tasks; one of over LEXICON_BYTES is an error."""
    tables = {
        "words": lexicon.words.select("word").union(lexicon.glossary.select("word")).union(lexicon.synonyms.select("word")).union(lexicon.synonyms.select("peer")).distinct(),
        "stop": lexicon.stop.select("word").distinct(), "typos": lexicon.typos.orderBy("ordinal").select("typo", "word"), "sounds": lexicon.sounds.select("char", "sound"),
        "glossary": lexicon.glossary.groupBy("word").agg(F.min("place").alias("place")).orderBy("place", "word").select("word"),
    }
    size = sum(rows.agg(F.sum(F.octet_length(F.concat_ws("", *rows.columns)) + 64)).first()[0] or 0 for rows in tables.values())
    if size > LEXICON_BYTES:
        raise ValueError(f"a lexicon takes {LEXICON_BYTES} bytes at most, this one {size}")
    rows = {k: [tuple(r) for r in t.collect()] for k, t in tables.items()}
    known = frozenset(w for (w,) in rows["words"] if w)
    out = Automaton(frozenset(w for (w,) in rows["stop"]), rows["typos"], dict(rows["sounds"]), {}, known, max([LEAST_REACH, *map(len, known)]))
    for (word,) in rows["glossary"]:
        out.canonical.setdefault(out.sound(word), word)
    out.canonical.pop(None, None)
    return out


def segmented(text: Column, lexicon: Automaton) -> Column:
    """struct(words, phrases) of a text; those of a null text are empty."""
    import pandas as pd

    return F.pandas_udf(lambda s: pd.DataFrame([lexicon.segment(t) for t in s], columns=["words", "phrases"]), "words array<string>, phrases array<string>")(text)


def sounds_of(words: DataFrame, sounds: DataFrame) -> DataFrame:
    """(word, sound) of ``words(word)`` of two characters or more whose characters all have a sound."""
    chars = words.select("word").distinct().select("word", F.posexplode(F.filter(F.split("word", ""), lambda c: c != "")).alias("i", "char"))
    spoken = chars.join(sounds.select("char", "sound"), "char").groupBy("word").agg(F.array_sort(F.collect_list(F.struct("i", "sound"))).alias("s"))
    return spoken.where((F.size("s") == F.length("word")) & (F.length("word") > 1)).select("word", F.array_join("s.sound", "").alias("sound"))


def query_plan(queries: DataFrame, lexicon: Lexicon, tries: Automaton) -> DataFrame:
    """(id, kind, token, rank) of ``queries(id, text)``: what a query in either language searches for, in the order that later caps consume.

    ``english`` and ``stem``: the query's own, then the sounds of the Chinese words that these mean, then sounds and English of its Chinese words and of
    those that it spells by sound. ``chinese``: its own, those its English means, then synonyms, which are not taken back to English.
    ``phrase`` and ``identifier``: as they stand; ``tests`` where it asks for tests. A token's place is its first.
    """
    base = queries.select("id", F.pandas_udf(lambda s: s.map(lambda t: tries.right(t or "")), "string")("text").alias("text"))
    found = base.select("id", "text", segmented(F.col("text"), tries).alias("zh"), search.query_words(F.col("text")).alias("en"))
    found = found.withColumn("stems", search.stems(F.col("en")))
    at = lambda *c: F.array(*(F.lit(x).cast("int") if isinstance(x, int) else F.col(x).cast("int") for x in c))
    own = lambda column: found.select("id", F.posexplode(column).alias("o", "token"))
    gloss = lexicon.glossary.select("word", F.lower("english").alias("english"), "place", "ordinal")
    said = sounds_of(gloss.select("word"), lexicon.sounds)
    places = gloss.groupBy("word").agg(F.min("place").alias("place"))
    keys = gloss.select(F.col("english").alias("key"), "word", F.lit(False).alias("spelled")).union(said.select("sound", "word", F.lit(True)))
    keys = keys.groupBy("key", "word").agg(F.max("spelled").alias("s")).join(places, "word")
    by_sound = keys.groupBy("key").agg(F.max("s").alias("spelled"))
    keys = keys.join(by_sound, "key")
    asked = found.select("id", F.posexplode(F.concat("en", "stems")).alias("p", "key")).groupBy("id", "key").agg(F.min("p").alias("p"))
    meant = asked.join(keys, "key").select("id", "word", "p", "place", "spelled")
    zh = own("zh.words").select("id", F.col("token").alias("word"), at(0, "o", 0).alias("at"))
    primary = zh.union(meant.select("id", "word", at(1, "p", "place").alias("at"))).groupBy("id", "word").agg(F.min("at").alias("at"))
    forward = zh.union(meant.where("spelled").select("id", "word", at(1, "p", "place").alias("at"))).groupBy("id", "word").agg(F.min("at").alias("at"))
    all_said = sounds_of(primary.select("word"), lexicon.sounds)
    spoken = meant.join(all_said, "word").select("id", F.col("sound").alias("token"), at(1, "p", "place").alias("at"))
    abroad = forward.join(all_said, "word").select("id", F.col("sound").alias("token"), F.concat(at(2), "at", at(0)).alias("at"))
    english = forward.join(gloss, "word").select("id", F.col("english").alias("token"), F.concat(at(2), "at", at(1), F.array(F.col("ordinal").cast("int"))).alias("at"))
    kind = lambda rows, name: rows.select("id", F.lit(name).alias("kind"), "token", "at")
    first = lambda column: own(column).select("id", "token", at(0, "o").alias("at"))
    peers = primary.join(lexicon.synonyms, "word").select("id", F.col("peer").alias("token"), F.concat(at(2), "at", F.array(F.col("ordinal").cast("int"))).alias("at"))
    identifiers = F.array_distinct(F.transform(F.regexp_extract_all("text", F.lit(r"[a-zA-Z_$][a-zA-Z0-9_$/.:-]+"), F.lit(0)), F.lower))
    every = kind(first("en").union(spoken).union(abroad).union(english), "english")
    every = every.union(kind(first("stems").union(spoken).union(abroad).union(english.withColumn("token", L.stem(F.col("token")))), "stem"))
    every = every.union(kind(primary.select("id", F.col("word").alias("token"), "at").union(peers), "chinese")).union(kind(first("zh.phrases"), "phrase"))
    every = every.union(kind(first(F.filter(identifiers, lambda x: ~x.isin(search.STOP_WORDS))), "identifier"))
    tests = every.where((F.col("kind") == "chinese") & F.col("token").isin(TEST_WORDS)).select("id").union(base.where(F.col("text").rlike(TEST_PATTERN)).select("id")).distinct()
    every = every.union(tests.select("id", F.lit("tests").alias("kind"), F.lit("tests").alias("token"), at(0).alias("at")))
    once = every.groupBy("id", "kind", "token").agg(F.min("at").alias("at"))
    return once.select("id", "kind", "token", F.row_number().over(Window.partitionBy("id", "kind").orderBy("at", "token")).alias("rank"))


def concept_tokens(texts: DataFrame, lexicon: Lexicon, tries: Automaton) -> DataFrame:
    """(id, token) of ``texts(id, text)``: words and stems of two letters or more, Chinese words and their sounds, each once."""
    found = texts.select("id", english_words(F.col("text")).alias("en"), segmented(F.col("text"), tries)["words"].alias("zh"))
    found = found.withColumn("en", F.filter("en", lambda w: ~w.isin(search.STOP_WORDS)))
    latin = found.select("id", F.explode(F.filter(F.array_union("en", search.stems(F.col("en"))), lambda w: F.length(w) >= 2)).alias("token"))
    words = found.select("id", F.explode("zh").alias("word"))
    spoken = words.join(sounds_of(words, lexicon.sounds), "word").select("id", F.col("sound").alias("token"))
    return latin.union(words).union(spoken).distinct()
