"""Defective answers to prompts, each with its type of defect.

Copies are found by compression with zstandard: with the prompt as dictionary next to nothing is left of
the answer, and with the answer as dictionary next to nothing of the prompt. Dictionaries of wordings
and scripts tell refusals and other languages. Whether an answer breaks off is told by what its end leaves open and by a terminal-context
model: how often the last token stands as a whole in all references, against how often it only begins
a longer one.
"""

from __future__ import annotations

import hashlib
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import regex
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from signloom.functions.text import parse_prediction
from signloom.llm.house_form import INVISIBLE, LOOK_ALIKE
from signloom.plans.durable import cut

NAMES_BOUND = 500_000
#: What may be left of an answer with its prompt as dictionary (a label, say), and of the prompt with the answer as dictionary.
COPY_NEW, COPY_LOST = 0.5, 0.25
FOREIGN_SHARE = 0.5
WHOLE_SHARE = 0.05

# Labels before an answer, and wordings of refusals.
LABEL = regex.compile(r"^\s*[*#]*\s*(?:gloss(?:es)?|answer|output|result|translation|sign|tsl|chinese|中文|原文|原句|句子|手語|手語詞序|詞序|答案|回答|輸出|結果|翻譯|譯文)\s*[*]*\s*[:：]\s*", regex.IGNORECASE)
REFUSAL = regex.compile(
    r"(?:無法|不能|沒辦法|不便|不方便|難以|不可以)[^/／]{0,10}(?:提供|協助|處理|翻譯|轉|回答|回覆|作答|完成|給出|產生)|拒絕(?:翻譯|回答|作答|提供|處理)|恕難|恕不|超出[^/／]{0,8}(?:能力|範圍)|不作答|資訊不足|不足以給出|身為[^/／]{0,6}模型|"
    r"(?i:can(?:no|')t (?:help|assist|do|translate|answer|provide|comply)|can ?not (?:help|assist|translate|answer|provide|comply)|unable to|(?:do|does) ?n[o']t know|as an? (?:\w+ )?(?:text|language|ai)\b[^/]{0,12}model|won't|will not (?:translate|answer|help)|i (?:must )?decline|i refuse|not able to|lo siento|je ne peux|kann (?:ich )?nicht)|"
    r"できません|できかねます|お答えでき|申し訳|いたしかねます|할 수 없|수 없습니다|죄송|không thể|xin lỗi"
)
SLASH, BREAKS = regex.compile("[/／]"), regex.compile(r"[\r\n\x0b\x0c\x85\u2028\u2029]+")
WORD, RUN = regex.compile(r"[\p{L}\p{M}]+"), regex.compile(r"\p{Han}+|[\p{L}\p{M}--\p{Han}]+", regex.V1)
LEAD = regex.compile(r"^[^：:\r\n]{1,40}[：:]")
WRAP = " \t\r\n\u3000`*~\"'「」『』“”‘’<>《》。．.!！?？,，、;；"
NOTE = regex.compile(r"\s*[（(][^（）()]*[）)]\s*$")
PAIRS = {"「": "」", "『": "』", "（": "）", "(": ")", "[": "]", "【": "】", "《": "》", "“": "”", "〈": "〉"}
DROPPED = dict.fromkeys(map(ord, INVISIBLE)) | {ord(a): b for a, b in LOOK_ALIKE.items()}


def letters(text: str) -> str:
    """Letters and digits only, look-alikes as one, without case."""
    return "".join(c for c in unicodedata.normalize("NFKC", text.translate(DROPPED)) if unicodedata.category(c)[0] in "LN").lower()


@lru_cache(1 << 16)
def _code(character: str) -> bytes:
    return hashlib.md5(character.encode()).digest()


def coded(text: str) -> bytes:
    """16 bytes for each character, the same for the same one: so a match is one of characters, and a short prompt long enough."""
    return b"".join(map(_code, text))


def _compressed(raw: bytes, dictionary: bytes) -> int:
    how = zstandard.ZstdCompressionParameters.from_level(3, source_size=len(raw), dict_size=len(dictionary), write_checksum=0, write_content_size=0, write_dict_id=0)
    given = zstandard.ZstdCompressionDict(dictionary, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    return len(zstandard.ZstdCompressor(compression_params=how, dict_data=given).compress(raw))


#: Bytes of a frame that says no more than "as in the dictionary".
NOTHING_NEW = _compressed(_code("x"), _code("x"))


def compressed_share(answer: str, prompt: str) -> float:
    """What the answer takes with its prompt as dictionary, beyond a frame that says nothing new, by its length."""
    if not answer or not prompt:
        return 1.0
    raw = coded(answer)
    return max(0, _compressed(raw, coded(prompt)) - NOTHING_NEW) / len(raw)


def unlabelled(text: str) -> str:
    while m := LABEL.match(text):
        text = text[m.end() :]
    return text


def is_copy(answer: str, prompt: str) -> bool:
    """The whole prompt given back: labelled, quoted, repeated, without marks or all but unchanged, but not cut into glosses."""
    if answer.count("/") + answer.count("／") > prompt.count("/") + prompt.count("／"):
        return False
    given = letters(prompt)
    for own in dict.fromkeys((letters(answer), letters(LEAD.sub("", answer)))):  # a lead-in up to a colon counts as a label
        if compressed_share(own, given) <= COPY_NEW and compressed_share(given, own) <= COPY_LOST:
            return True
    return False


def is_refusal(answer: str, tokens: list[str], names: frozenset[str]) -> bool:
    """A refusal's wording, in a text that isn't made of glosses."""
    return REFUSAL.search(answer) is not None and not (len(tokens) > 2 and sum(t.lower() in names for t in tokens) * 2 >= len(tokens))


def is_foreign(answer: str, prompt: str, ref: str, names: frozenset[str]) -> bool:
    """Most of its words are of another language or script: neither Han nor glosses nor words of the prompt."""
    known = foreign = 0
    own = f"{prompt} {ref}".lower()
    for word in WORD.findall(answer):
        for part in RUN.findall(word):
            if "\u4e00" <= part[0] <= "\u9fff" or regex.match(r"\p{Han}", part):
                known += len(part)
            elif part.lower() in names or part.lower() in own:
                known += len(part)
            else:
                foreign += len(part)
    return foreign > 0 and foreign >= FOREIGN_SHARE * (known + foreign)


def left_open(answer: str) -> bool:
    """A bracket or quotation that nothing closes, or a separator at the end."""
    stack: list[str] = []
    for c in answer:
        if c in PAIRS:
            stack.append(PAIRS[c])
        elif stack and c == stack[-1]:
            stack.pop()
    if stack or any(answer.count(q) % 2 for q in "\"`"):
        return True
    if sum(answer.count(q) for q in "'‘’") % 2:
        return True
    return answer.rstrip(WRAP).endswith(("/", "／", "-", "…", "—")) or answer.rstrip().endswith(("、", "，", ",", "：", ":", "；"))


def label(raw: str | None, prompt: str | None, ref: str | None, names: frozenset[str]) -> tuple[str | None, str | None]:
    """(defect, None), or (None, the last token where its end decides)."""
    raw, prompt, ref = raw or "", prompt or "", ref or ""
    answer = unlabelled(raw.strip())
    tokens = [t.strip(WRAP) for t in SLASH.split(answer)]
    if len(tokens) > 1 and "/" not in prompt and "／" not in prompt and all(t.lower() in names for t in tokens) and not BREAKS.search(answer):
        return ("truncated" if left_open(answer) else None), None  # glosses all through: no other defect can be
    if not any(unicodedata.category(c)[0] in "LN" for c in answer):
        return "empty", None
    if is_copy(answer, prompt) and letters(answer) not in names:
        return "copy", None
    if is_refusal(answer, tokens, names):
        return "refusal", None
    if is_foreign(answer, prompt, ref, names):
        return "other_language", None
    lines = [x for x in BREAKS.split(answer) if x.strip(WRAP)]
    sequence = [x for x in lines if "/" in x or "／" in x]
    last = unlabelled((sequence or lines)[-1].strip())
    if left_open(last):
        return "truncated", None
    last = NOTE.sub("", last)
    tail = SLASH.split(last)[-1].strip(WRAP)
    if not sequence and regex.search(r"[，,：:；;]|\p{Han}{7,}", last):  # an explanation, not a gloss
        return ("truncated" if not last.rstrip("`*\"'」』 ").endswith(("。", "！", "？", "!", "?", ".")) else None), None
    whole = not tail or tail.lower() in names or tail in (t.strip(WRAP) for t in SLASH.split(ref))
    return None, None if whole else tail


def defects(df: DataFrame, key: str, prompt: str, ref: str, raw: str, master: DataFrame, surface: str = "surface", aliases: str = "aliases", pred: str | None = None) -> DataFrame:
    """Rows ``id, defect`` of the defective answers, one type each: empty, copy, refusal, other_language or truncated.

    A null or blank answer is empty. A null prompt is copied by nothing, a null reference tells no
    token. Where ``pred``, what was kept of the answer, isn't what the parser makes of it, a sound answer is
    judged by that too. Repeated rows come out once; null keys are kept. Extra columns are not read.
    """
    every = master.select(F.explode(F.concat(F.array(surface), F.coalesce(aliases, F.array().cast("array<string>")))).alias("name")).filter("name <> ''").distinct()
    listed = every.limit(NAMES_BOUND + 1).collect()
    if len(listed) > NAMES_BOUND:
        raise ValueError(f"more than {NAMES_BOUND} glosses; raise NAMES_BOUND if the workers can hold them")
    shared = df.sparkSession.sparkContext.broadcast(frozenset(r["name"].lower() for r in listed))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = shared.value
        for batch in batches:
            found = []
            for p, f, r, k, other in zip(*(batch.column(i).to_pylist() for i in range(1, 6)), strict=True):
                first = label(r, p, f, names)
                found.append((*first, *(label(k, p, f, names) if other and not first[0] else (None, None))))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.string()) for c in ([x[i] for x in found] for i in range(4)))], names=["id", "defect", "tail", "kept_defect", "kept_tail"])

    own = df.select(F.col(key).alias("id"), F.col(prompt).alias("prompt"), F.col(ref).alias("ref"), F.col(raw).alias("raw"))
    kept = F.lit(None).cast("string") if pred is None else F.col(pred)
    other = F.lit(False) if pred is None else ~F.coalesce(kept, F.lit("")).eqNullSafe(parse_prediction(raw))
    judged = df.select(F.col(key).alias("id"), F.col(prompt).alias("prompt"), F.col(ref).alias("ref"), F.col(raw).alias("raw"), kept.alias("kept"), other.alias("other"))
    labelled = cut(judged.mapInArrow(run, "id string, defect string, tail string, kept_defect string, kept_tail string").filter("coalesce(defect, tail, kept_defect, kept_tail) is not null").distinct())
    tails = labelled.select(F.explode(F.array("tail", "kept_tail")).alias("tail")).filter("tail is not null").distinct()
    tokens = own.select(F.explode(F.split("ref", "[/／]")).alias("token")).select(F.trim("token").alias("token")).filter("token <> ''").groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    tokens = tokens.unionByName(every.select(F.col("name").alias("token"), F.lit(1).cast("long").alias("n")))
    begun = tokens.select(F.explode(F.expr("transform(sequence(1, length(token)), i -> substring(token, 1, i))")).alias("tail"), "token", "n")
    model = begun.join(tails, "tail", "left_semi").groupBy("tail").agg(F.sum(F.when(F.col("tail") == F.col("token"), F.col("n")).otherwise(0)).alias("whole"), F.sum("n").alias("n"))
    broken = cut(model.filter(F.col("whole") < WHOLE_SHARE * F.col("n")).select("tail"))
    ends = labelled.join(broken.withColumn("cut", F.lit("truncated")), "tail", "left").join(broken.select(F.col("tail").alias("kept_tail"), F.lit("truncated").alias("kept_cut")), "kept_tail", "left")
    return ends.select("id", F.coalesce("defect", "cut", "kept_defect", "kept_cut").alias("defect")).filter("defect is not null").distinct()
