"""Documents of template residue: unfilled placeholders, filler, error messages, notices about scripts.

A naive Bayes model of passages (hashed pairs of adjacent characters) is learnt from positive and
unlabelled data by expectation-maximisation. Trusted positives are the passages of records that
known error, script and filler wordings make up; all others are unlabelled. A second model, of what
stands around placeholders, is learnt in the same way: trusted are the placeholders of records in which
nothing at all is worded like an explanation; those of other records are unlabelled, and wordings
beside them are where the expectation begins, no more. Every passage of every document is then
scored, and each record is decided from its passages.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from signloom.plans.durable import cut, release

FIT_DOCUMENTS = 20_000
FEATURE_BITS = 18
NOTHING = 2**FEATURE_BITS
EM_ROUNDS = 8
SETTLED = 0.01
#: Records, and their share of all, that make a passage reliably content: the greater counts.
RECURS = 8
RECURS_SHARE = 0.0004
#: Passages of each kind that are fitted for a document of the bound.
FIT_PASSAGES = 2
SUMS = ("trusted", "n", "beside", "usual")
SMOOTHING = 0.03
#: Longer passages are no trusted wording, and records of more passages no trusted record; the model judges them all the same.
MOST_KNOWN, MOST_TRUSTED = 160, 24
#: The first belief in an unlabelled placeholder's being unfilled, without and with an explaining wording beside it.
LIKELY = (0.9, 0.1)

# Ways in which template languages and authors write a place to be filled.
SLOTS = (
    r"\{\{[^{}\n]{1,40}\}\}", r"\$\{[^{}\n]{1,40}\}", r"#\{[^{}\n]{1,40}\}", r"<%[^%\n]{1,40}%>", r"\{%[^%\n]{1,40}%\}", r"(?<![{$#\\A-Za-z0-9])\{[A-Za-z0-9_.]{1,24}\}(?!\})",
    r"\[\[[^\[\]\n]{1,40}\]\]", r"<<[^<>\n]{1,40}>>", r"@@\w{1,24}@@", r"(?<![A-Za-z0-9_])__[A-Za-z]\w{0,24}?__(?![A-Za-z0-9_])", r"%\(\w{1,24}\)[sdfr]", r"(?<![A-Za-z0-9%])%[sd](?![A-Za-z])", r"(?<![A-Za-z0-9$])\$[A-Z][A-Z_]{1,24}\$",
    r"(?i:[<\[【（(]\s*(?:your|insert|enter|add|put|fill in)\b[^<>\[\]【】（）()\n]{0,40}[>\]】）)])", r"[<\[【（(](?:請?(?:在此)?(?:填入|輸入|插入|補上?)|此處[補填插]|待[填補])[^<>\[\]【】（）()\n]{0,20}[>\]】）)]",
    r"(?i)(?<![A-Za-z])X{2,4}年X{2}月(?:X{2}日)?", r"[○〇＿]{2,}年[○〇＿]{1,2}月", r"(?<![A-Za-z])(?:TODO|TBD|FIXME)(?![A-Za-z])",
)
# Wordings by which a sentence speaks about a placeholder.
EXPLAINS = r"(?i)代表|說明|寫著|寫法|寫成|範本|模板|欄位|換成|帶入|表示|stands? for|replaced|means|template|placeholder|syntax|written as|in the (?:guide|manual)"
# Wordings of script notices, error messages and filler.
SEEDS = (
    r"(?i)java\s?script|noscript|指令碼|(?:enable|allow|允許|啟用).{0,12}cookie|scripts? (?:appear|to be|支援|are )|停用 js|checking your browser|"
    r"internal server error|bad gateway|service unavailable|gateway time-?out|page not found|not found on this server|request timed out|access denied|forbidden|connection refused|something went wrong|fatal error|uncaught exception|traceback \(most|sqlstate|stack trace|nullpointer|"
    r"\bhttp \d{3}\b|\berror \d{3}\b|錯誤代碼|發生錯誤|找不到您要的|頁面不存在|存取被拒|連線逾時|系統維護|暫停服務|無法處理|\"status\": ?\d+|keyerror|"
    r"\b(?:lorem|ipsum|dolor|amet|consectetur|adipiscing|vitae)\b|\b(\w{3,})\s+\1\b|placeholder (?:text|paragraph)|dummy (?:text|line)|sample text|text goes here|caption here|coming soon|asdf|qwer|text text|"
    r"範例文字|測試測試|請輸入文字|假文|內容建置中|標題文字|段落內容|這裡是內文|文字文字|此處為說明|^(.{2,10}?)\2+[。！!.]?$"
)
# What a passage with one of these wordings holds at least; but for the two kinds of repetition.
NEEDLES = (
    "java", "script", "指令碼", "cookie", "停用 js", "checking your browser", "internal server error", "bad gateway", "service unavailable", "gateway time", "page not found", "not found on this server", "request timed out",
    "access denied", "forbidden", "connection refused", "something went wrong", "fatal error", "uncaught exception", "traceback (most", "sqlstate", "stack trace", "nullpointer", "http ", "error ", "錯誤代碼", "發生錯誤", "找不到您要的",
    "頁面不存在", "存取被拒", "連線逾時", "系統維護", "暫停服務", "無法處理", '"status":', "keyerror", "lorem", "ipsum", "dolor", "amet", "consectetur", "adipiscing", "vitae", "placeholder ", "dummy ", "sample text", "text goes here",
    "caption here", "coming soon", "asdf", "qwer", "text text", "範例文字", "測試測試", "請輸入文字", "假文", "內容建置中", "標題文字", "段落內容", "這裡是內文", "文字文字", "此處為說明",
)
SLOT = regex.compile("|".join(SLOTS))
EXPLAIN = regex.compile(EXPLAINS)
# Passages are lower case: the same without regard to case, in a quarter of the time, once the letters whose lower case is two are one.
SEED = re.compile(SEEDS.removeprefix("(?i)"))
FOLDED = (("ſ", "s"), ("ς", "σ"))
REPEATED = re.compile(r"^(.{2,10}?)\1+[。！!.]?$")
# A line breaks after a mark, and after a full stop before white space or a Han character.
LINES = (*((c, "\n") for c in "\r\x0b\x0c\x85\u2028\u2029"), *((c, f"{c}\n") for c in "。！？｡!?"))
STOP = re.compile(r"\.(?=\s|[\u3005\u3007\u3021-\u3029\u3038-\u303b\u2e80-\u2fd5\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufad9\U00020000-\U0003fffd])")
GAP = re.compile(r"\s\s+")
MARK = "\x02"
NUMBER = regex.compile(r"\d+")
QUOTED = regex.compile("「[^「」]*」")
AROUND = regex.compile(r"[^\x02]{0,16}\x02[^\x02]{0,24}", regex.DOTALL)


def _replaced(text: str, pairs: tuple[tuple[str, str], ...]) -> str:
    for a, b in pairs:
        text = text.replace(a, b)
    return text


def passages(text: str) -> tuple[list[str], list[str]]:
    """The sentences and lines of a text, placeholders put as one sign and quotations emptied, and what stands around each placeholder."""
    slotted = GAP.sub("\n", STOP.sub(".\n", _replaced(SLOT.sub(MARK, text.replace("\xa0", " ")), LINES)))
    parts = [p for p in (p.strip(" \t\u3000\ufeff\u200b-•*").lower() for p in slotted.split("\n")) if p]
    around = [w.group() for p in parts if MARK in p for w in AROUND.finditer(p)]
    return [QUOTED.sub("「」", p) for p in parts], around


def _features(rows: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed pairs and triples of adjacent characters of all passages in a row (2 x n), and where each passage's begin.

    Borders count as characters and digits as one. The last place of each passage holds no feature.
    """
    points = np.frombuffer(("\x03" + "\x03\x03".join(rows) + "\x03\x03").encode("utf-32-le"), np.uint32).astype(np.uint64)
    points = np.where((points >= 48) & (points <= 57), np.uint64(48), points)
    h = points[:-2] * np.uint64(0x9E3779B97F4A7C15) ^ points[1:-1] * np.uint64(0xC2B2AE3D27D4EB4F)
    both = np.stack([h, h ^ points[2:] * np.uint64(0x165667B19E3779F9) ^ np.uint64(0x27D4EB2F165667C5)])
    both = ((both ^ (both >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(64 - FEATURE_BITS)
    lengths = np.fromiter(map(len, rows), np.int64, len(rows)) + 2
    ends = np.cumsum(lengths)
    both = np.append(both.astype(np.int64), np.full((2, 1), NOTHING), axis=1)[:, : ends[-1]]
    both[:, ends - 1] = NOTHING
    return both, ends - lengths


def _scores(odds: np.ndarray, rows: list[str]) -> np.ndarray:
    if not rows:
        return np.zeros(0)
    features, starts = _features(rows)
    return np.add.reduceat(odds[features].sum(axis=0, dtype=float), starts)


def expectation_maximisation(rows: list[str], times: np.ndarray, state: np.ndarray, first: np.ndarray, rounds: int = EM_ROUNDS) -> np.ndarray:
    """Log-odds of the features from passages that are positive (state 1), unlabelled (0) or reliably negative (-1).

    Only the belief in unlabelled passages moves, from ``first`` on. A feature never seen says nothing.
    """
    odds = np.zeros(NOTHING + 1, "<f4")
    if not (state > 0).any():
        return odds
    features, starts = _features(rows)
    owner = np.repeat(np.arange(len(rows)), np.diff(np.append(starts, features.shape[1])))
    belief = np.where(state, state > 0, first).astype(float)
    whole = np.bincount(features.ravel(), np.tile(times[owner], 2), NOTHING + 1)[:-1]
    for _ in range(rounds):
        some = (belief > 1e-6)[owner]  # few passages: only their features are counted again
        positive = np.bincount(features[:, some].ravel(), np.tile((belief * times)[owner[some]], 2), NOTHING + 1)[:-1]
        negative = np.maximum(whole - positive, 0)
        p, n = positive.sum(), max(negative.sum(), 1.0)
        odds[:-1] = np.log((positive + SMOOTHING) / p) - np.log((negative + SMOOTHING * n / p) / n)
        score = np.add.reduceat(odds[features].sum(axis=0, dtype=float), starts)
        share = min(max((belief * times).sum() / times.sum(), 1e-6), 0.5)
        before, belief = belief, np.where(state, state > 0, 1 / (1 + np.exp(-np.clip(score + np.log(share / (1 - share)), -30, 30))))
        if np.abs(belief - before).max() < SETTLED:
            break
    return odds


@lru_cache(1)
def _needles() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for n in NEEDLES:
        found.add_word(n, n)
    found.make_automaton()
    return found


def is_known(passage: str) -> bool:
    """Whether a passage (lower case) is of a known wording; most hold no part of one and need no closer look."""
    folded = _replaced(passage, FOLDED)
    if next(_needles().iter(folded), None) is None and REPEATED.search(folded) is None:
        words = folded.split()
        if len(words) < 2 or not any(a[-3:] == b[: len(a)][-3:] or b.startswith(a[-3:]) for a, b in zip(words, words[1:])):
            return False
    return SEED.search(folded) is not None


def count(texts: list[str]) -> dict[tuple[bool, str], list[float]]:
    """By (whether it stands around a placeholder, passage but for its numbers): how often it is trusted, how often not, known wording beside it, records where it is usual.

    Passages of records that known wordings make up are trusted residue. Usual is a passage in a record of some
    length nearly free of them. A placeholder is trusted to be unfilled where no passage of its record is worded like
    an explanation; else how likely it is at first depends on whether such a wording stands by it.
    """
    found: dict[tuple[bool, str], list[float]] = {}
    known: dict[str, bool] = {}
    for text in texts:
        parts, around = passages(text)
        plain = [NUMBER.sub("0", p) for p in parts]
        for p, q in zip(parts, plain, strict=True):
            if q not in known:
                known[q] = len(p) < MOST_KNOWN and is_known(p)
        hits = [known[q] for q in plain]
        residue = len(parts) <= MOST_TRUSTED and sum(hits) * 2 >= len(parts)
        beside = sum(hits) / len(parts) if parts and sum(hits) * 3 >= len(parts) else 0
        for p, h in zip(plain, hits, strict=True):
            of = found.setdefault((False, p), [0, 0, 0, 0])
            if h and residue:
                of[0] += 1
            else:
                of[1] += 1
                of[2] += beside
        if len(parts) >= 4 and sum(hits) * 5 <= len(parts):
            for p in {p for p, h in zip(plain, hits, strict=True) if not h}:
                found[False, p][3] += 1
        trusted = around and not any(map(EXPLAIN.search, parts))
        for w in around:
            of = found.setdefault((True, w), [0, 0, 0, 0])
            if trusted:
                of[0] += 1
            else:
                of[1] += 1
                of[2] += LIKELY[EXPLAIN.search(w) is not None]
    return found


def fit(rows: list[tuple[bool, str, float, float, float, float]], recurs: float) -> np.ndarray:
    """Two models, of passages and of what stands around placeholders (2 x features), from the sums of ``count``.

    A passage that is usual in ``recurs`` records is reliably content; others that aren't trusted are
    unlabelled, those around placeholders always.
    """
    models = []
    for slot in (False, True):
        own = sorted(r[1:] for r in rows if r[0] == slot)
        c = [(p, trusted, 1, 0.0) for p, trusted, _, _, _ in own if trusted]
        c += [(p, n, -1 if not slot and usual >= recurs else 0, beside) for p, _, n, beside, usual in own if n]
        times, state = np.array([n for _, n, _, _ in c], float), np.array([t for _, _, t, _ in c], int)
        first = np.array([beside for _, _, _, beside in c]) / times  # how much known wording stands beside a passage
        models.append(expectation_maximisation([p for p, _, _, _ in c], times, state, first) if c else np.zeros(NOTHING + 1, "<f4"))
    return np.stack(models)


def _count_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = count(batch.column(0).to_pylist())
        columns = [pa.array([s for s, _ in found], pa.bool_()), pa.array([p for _, p in found], pa.string())]
        yield pa.RecordBatch.from_arrays(columns + [pa.array([float(v[i]) for v in found.values()], pa.float64()) for i in range(4)], names=["slot", "passage", *SUMS])


def learn(df: DataFrame, key: str, text: str, most: int = FIT_DOCUMENTS) -> bytes:
    """The model. Passages are counted over all documents; some of them, by hash, are fitted in one task.

    Of passages with trusted places or known wording beside them, of others that stand ``RECURS`` times and of
    the rest, about ``most`` times ``FIT_PASSAGES`` each are fitted; those weigh for the ones left out.
    """
    n = df.count()
    texts = df.select(text).filter(F.col(text).isNotNull())
    parts = texts.mapInArrow(_count_task, "slot boolean, passage string, " + ", ".join(f"{c} double" for c in SUMS))
    kind = F.when(F.col("slot"), 0).when((F.col("trusted") > 0) | (F.col("beside") > 0), 1).when(F.col("n") >= RECURS, 2).otherwise(3)
    counted = cut(parts.groupBy("slot", "passage").agg(*[F.sum(c).alias(c) for c in SUMS]).withColumn("kind", kind))
    rates = {r["kind"]: min(1.0, most * FIT_PASSAGES / r["count"]) for r in counted.groupBy("kind").count().collect()}
    if not rates:
        return bytes(8 * (NOTHING + 1))
    rate = F.element_at(F.create_map(*[F.lit(x) for kv in rates.items() for x in kv]), F.col("kind"))
    some = counted.withColumn("rate", rate).filter(chosen(F.xxhash64("passage"), F.col("rate")))
    scale = min(1.0, FIT_DOCUMENTS / max(n, 1))  # SMOOTHING is meant for counts of that many
    weighed = some.select("slot", "passage", *[(F.col(c) * scale / F.col("rate")).alias(c) for c in SUMS[:3]], "usual")
    recurs = max(RECURS, RECURS_SHARE * n)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [r for b in batches for r in zip(*(c.to_pylist() for c in b.columns), strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array([fit(rows, recurs).tobytes()], pa.binary())], names=["model"])

    found = weighed.repartition(1).mapInArrow(run, "model binary").collect()
    release(counted)
    if not found:
        raise RuntimeError("no passage was chosen for the fit")
    return bytes(found[0]["model"])


def chosen(hashed: Column, rate: Column) -> Column:
    """Whether a 64-bit hash is among the ``rate`` of all, which may be smaller than any count of buckets."""
    return hashed.cast("double") / 2.0**64 + 0.5 <= rate


def decide(parts: list[str], scores: list[float], around: list[float]) -> str | None:
    """The kind of residue a record is, or none: an unfilled placeholder anywhere, or residue with no more than a heading beside it."""
    if any(s > 0 for s in around):
        return "placeholder"
    said = [(len(p), s > 0 and MARK not in p) for p, s in zip(parts, scores, strict=True) if any(c.isalpha() for c in p)]
    bad, good = sum(n for n, residue in said if residue), [n for n, residue in said if not residue]
    return "residue" if bad and len(good) <= 1 and bad * 2 >= sum(good) else None


def judge(df: DataFrame, key: str, text: str, model: bytes | None = None) -> DataFrame:
    """Rows ``key, is_residue, kind, residue_share``, one for each row of ``df``.

    Null, empty and blank texts are no residue. Repeated rows are judged alike. Other columns are not
    read. An empty table gives no rows.
    """
    shared = df.sparkSession.sparkContext.broadcast(learn(df, key, text) if model is None else model)
    schema = T.StructType([*df.select(key).schema.fields, T.StructField("is_residue", T.BooleanType()), T.StructField("kind", T.StringType()), T.StructField("residue_share", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = np.frombuffer(shared.value, "<f4").reshape(2, NOTHING + 1)
        for whole in batches:
            for start in range(0, whole.num_rows, 1000):
                batch = whole.slice(start, 1000)
                split = [passages(t) if t else ([], []) for t in batch.column(1).to_pylist()]
                scores, around = (_scores(model[i], [p for s in split for p in s[i]]).tolist() for i in range(2))
                kinds, shares, at, slot = [], [], 0, 0
                for parts, slots in split:
                    own = scores[at : at + len(parts)]
                    kinds.append(decide(parts, own, around[slot : slot + len(slots)]))
                    shares.append(sum(s > 0 for s in own) / len(own) if own else 0.0)
                    at, slot = at + len(parts), slot + len(slots)
                flags = pa.array([k is not None for k in kinds], pa.bool_())
                yield pa.RecordBatch.from_arrays([batch.column(0), flags, pa.array(kinds, pa.string()), pa.array(shares, pa.float64())], names=schema.names)

    return df.select(key, text).mapInArrow(run, schema)
