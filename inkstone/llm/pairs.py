"""Defects of prompt and response pairs.

A response that only repeats its prompt is found by compression: with the prompt
as a zstandard dictionary it shrinks to almost nothing; the letters are compared
only of those that do.  The language of both sides comes from scripts
and dictionaries of function words, refusals from a dictionary of phrases.
Whether a response breaks off is judged by its form (open brackets, fences and
list items, half numbers) and, where it just ends in a word, by a model of
terminal contexts: how often the last words end a sentence, and how often they
are followed by more, anywhere in the corpus.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from difflib import SequenceMatcher

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkstone.runtime import fit_parallelism, materialize

#: A context is kept from this share of all responses on, and from this number on.  That bounds the model by 3 contexts a word of a
#: mean response / ``KEEP``: at most 150,000 times the words of a mean response, a few million entries; real text has far fewer.
KEEP, LEAST = 2e-5, 4
#: Share of sentence ends from which a context is terminal.
TERMINAL = 0.5
#: Bytes and share of a response that may be left with the prompt as dictionary, and one letter in so many that may differ.
COPY_REST, COPY_SHARE, COPY_LETTERS = 18, 0.05, 16
#: Letters of a label beside a copy, as "A:" or "답변:".
COPY_LABEL = 5

#: Function words of languages in Latin letters.
FUNCTION_WORDS = {
    "en": "the of and to in is for that with by was on at its an as are from this it will has been because our which",
    "fr": "le la les des et est dans une pour que qui sur par avec du au aux ce cette sont plus",
    "de": "der die das und ist in den von mit zu im für auf eine ein nicht des dem als auch",
    "es": "el la los las de y es en una un para que por con del se su como más al",
}
_FUNCTION = {w: {k for k, v in FUNCTION_WORDS.items() if w in v.split()} for v in FUNCTION_WORDS.values() for w in v.split()}

#: How a question asks for an answer in a certain language.
ASKED = {
    "en": r"영어로|영문으로|in english|英語で|用英语",
    "ko": r"한국어로|한글로|국문으로|in korean|韓国語で|用韩语",
    "ja": r"일본어로|일어로|in japanese|日本語で|用日语",
    "zh": r"중국어로|in chinese|中国語で|用中文",
    "fr": r"프랑스어로|불어로|in french|en français",
    "de": r"독일어로|in german|auf deutsch",
    "es": r"스페인어로|in spanish|en español",
}
_ASKED = {k: re.compile(v, re.IGNORECASE) for k, v in ASKED.items()}
_TRANSLATE = re.compile(r"번역|translate", re.IGNORECASE)

#: Phrases by which an assistant declines.
REFUSALS = (
    r"답변\s*(?:을|은|이)?\s*(?:드릴|해\s*드릴|할|드리)\s*수\s*(?:가\s*)?없",
    r"(?:답|답변|응답|대답)하지\s*않겠",
    r"(?:도와드릴|도와\s*드릴|도움을\s*드릴|알려\s*드릴|안내해?\s*드릴|안내할|제공해?\s*드릴|제공할|수행할|처리할|응할|다룰|말씀드릴|공유해?\s*드릴)\s*수\s*(?:가\s*)?(?:없|있는\s*범위가\s*아니)",
    r"(?:도움을|답변을|답변|안내를|말씀을|정보를)?\s*드리기(?:는|가)?\s*(?:어렵|곤란|힘들)",
    r"말씀드리기(?:는|가)?\s*(?:어렵|곤란|힘들)",
    r"(?:응답|답변|대답|안내)(?:이|은|는|가)?\s*(?:제한|거부|불가)",
    r"(?:언급|답변|응답|의견\s*제시|논의|조언)(?:을|를|은|는)?\s*(?:삼가|거절|사양|피하|자제)",
    r"(?:요청|질문|작업|문의)(?:은|는|을|를)?\s*(?:처리|수행|지원|수락|진행)하지\s*(?:않|못)",
    r"다루지\s*않는\s*(?:주제|내용|분야)",
    r"제\s*(?:역할|권한|업무|범위)(?:을|를)?\s*벗어나",
    r"\bI(?:['’]m| am)? (?:have to|must|need to|would have to|will have to)?\s*(?:respectfully |politely )?(?:decline|refuse|refrain)\b",
    r"\bI(?:['’]m afraid I)? ?(?:cannot|can['’]?t|can not|won['’]?t|will not|am unable to|['’]m unable to|am not able to|['’]m not able to|do not|don['’]t) (?:be able to )?(?:help|assist|answer|respond|provide|discuss|give|comment|share|offer|fulfil|fulfill|comply|do that|support|engage|address|take|handle|advise|speak|disclose|cover|process)",
    r"\b(?:unable|not able|not allowed|not permitted|not in a position) to (?:help|assist|answer|respond|provide|discuss|give|comment|share|offer|fulfil|fulfill|comply|support|address|advise)",
    r"(?:guidelines|policy|policies|rules|instructions) (?:prevent|prohibit|forbid|do not allow|don['’]t allow|stop|keep)\w* me",
    r"(?:falls?|is|lies?) (?:outside|beyond) (?:what I|my|the scope of what I)",
    r"not something I(?: am|['’]m)? (?:will|can|could|able|allowed|willing)",
    r"\bI(?:['’]d| would)? (?:rather|prefer) not\b",
    r"not (?:comfortable|at liberty)",
    r"(?:topics?|subjects?|questions?|requests?) I (?:do not|don['’]t|cannot|can['’]t|am not able to) (?:cover|discuss|answer|handle|take)",
    r"(?:is|are) (?:not|off)[- ]?(?:a |limits)?(?:topic|subject)?s? ?(?:that )?I (?:can|may|am able)",
)
_REFUSAL = re.compile("|".join(REFUSALS), re.IGNORECASE)

_WORDY = re.compile(r"[^\W_]")
_SENTENCE_END = ".!?。！？"
_WORD = re.compile(r"\S+")
_LABEL = re.compile(r"^\W*(?:출처|자료|참고|근거|주|source|sources|note|ref|reference|references)\s*[:：]\s*\S", re.IGNORECASE)
_MARK = re.compile(r"^\s*(?:[-•*▪]|\(?\d{1,2}[.)])\s*$")
_BARE_NUMBER = re.compile(r"(?:^|\s)[-+]?\d[\d,]*(?:\.\d+)?[.]$")
_PAIRS = {")": "(", "]": "[", "}": "{", "）": "（", "」": "「", "”": "“"}


def is_empty(output: str | None) -> bool:
    """Whether a response has no letter and no digit."""
    return not output or _WORDY.search(output) is None


def _plain(text: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFKC", text).casefold() if c.isalnum())


_ALONE = zstandard.ZstdCompressionParameters.from_level(19, format=zstandard.FORMAT_ZSTD1_MAGICLESS, write_content_size=False, write_checksum=False, write_dict_id=False)
_PAD = b"\0" * 8  # the least that zstandard takes for a dictionary


def remainder(source: bytes, raw: bytes) -> int:
    """Bytes that are left of ``raw`` with ``source`` as dictionary, beyond what a copy of the source leaves."""
    packer = zstandard.ZstdCompressor(compression_params=_ALONE, dict_data=zstandard.ZstdCompressionDict(_PAD + source, dict_type=zstandard.DICT_TYPE_RAWCONTENT))
    return len(packer.compress(raw)) - len(packer.compress(source))


def is_copy(prompt: str | None, output: str) -> bool:
    """Whether a response is only its prompt again, up to case, width, spaces, signs, a short label and single misspelt letters, once or more.

    The response is compressed with the prompt as dictionary; if that leaves more
    than ``COPY_REST`` bytes and ``COPY_SHARE`` of its own size, it is no copy.
    What is left then is looked at letter by letter: digits may not differ, and
    beside a label in front or behind one letter in ``COPY_LETTERS`` may.
    """
    if not prompt:
        return False
    a, b = _plain(prompt), _plain(output)
    if not a or len(b) < 0.9 * len(a):
        return False
    source, raw = a.encode(), b.encode()
    if remainder(source, raw) > COPY_REST + COPY_SHARE * min(len(raw), len(source)):
        return False
    times = max(1, round(len(b) / len(a)))  # the prompt may be given more than once
    whole = a * times
    if whole in b and len(b) <= len(whole) + COPY_LABEL or whole.startswith(b):
        return True
    if re.sub(r"\D", "", whole) != re.sub(r"\D", "", b):
        return False
    wrong = sum(max(i1 - i0, j1 - j0) for tag, i0, i1, j0, j1 in SequenceMatcher(None, whole, b, autojunk=False).get_opcodes() if tag != "equal")
    return wrong <= len(a) // COPY_LETTERS


def language(text: str) -> str | None:
    """Code of a text's language; None where there is too little prose to tell."""
    hangul = kana = han = 0
    for c in text:
        o = ord(c)
        if 0xAC00 <= o <= 0xD7A3:
            hangul += 1
        elif 0x3040 <= o <= 0x30FF:
            kana += 1
        elif 0x4E00 <= o <= 0x9FFF:
            han += 1
    if kana >= 3 and kana + han > hangul:
        return "ja"
    if han >= 4 and han > hangul:
        return "zh"
    if hangul >= 3:
        return "ko"
    words = re.findall(r"[^\W\d_]+", text.lower())
    votes: Counter[str] = Counter()
    for w in words:
        for k in _FUNCTION.get(w, ()):
            votes[k] += 1
    if votes and len(words) >= 4:
        return votes.most_common(1)[0][0]
    return "en" if sum(w.isascii() and len(w) > 2 for w in words) >= 3 and hangul == 0 and any(w.islower() for w in text.split()) else None


def wrong_language(prompt: str | None, output: str) -> bool:
    """Whether a response is in another language than its prompt, which did not ask for that."""
    if not prompt or _TRANSLATE.search(prompt):
        return False
    asked = {k for k, p in _ASKED.items() if p.search(prompt)}
    mine, theirs = language(prompt), language(output)
    return mine is not None and theirs is not None and mine != theirs and theirs not in asked


def is_refusal(output: str) -> bool:
    """Whether the assistant declines; a sentence that goes on to give the answer doesn't count."""
    return _REFUSAL.search(output) is not None


def _mask(word: str) -> str:
    return re.sub(r"\d+(?:[.,]\d+)*", "9", word)


def contexts(words: list[str]) -> list[str]:
    """The contexts of a place behind some words, the longest first."""
    return [" ".join(words[-n:]) for n in (3, 2, 1) if len(words) >= n]


def events(text: str) -> Iterator[tuple[str, bool]]:
    """(context, whether a sentence ends there) of all places behind words but the last of the text."""
    lines = text.split("\n")
    for i, line in enumerate(lines):
        words: list[str] = []
        found = _WORD.findall(line)
        for k, raw in enumerate(found):
            bare = raw.rstrip(_SENTENCE_END)
            stop = bare != raw
            words.append(_mask(bare) or raw)
            last = k == len(found) - 1
            if not (last and i == len(lines) - 1 and not stop):
                yield from ((c, stop or last) for c in contexts(words))
            if stop:
                words = []


def _open(text: str) -> bool:
    """Whether a bracket, fence or quoted value stays open."""
    if text.count("```") % 2:
        return True
    stack: list[str] = []
    for c in re.sub(r"```.*?```", "", text, flags=re.DOTALL):
        if c in "([{（「“":
            stack.append(c)
        elif c in _PAIRS and stack and stack[-1] == _PAIRS[c]:
            stack.pop()
    return bool(stack)


def is_truncated(output: str, terminal: dict[str, float]) -> bool:
    """Whether a response breaks off; ``terminal`` has the share of sentence ends by context."""
    text = output.rstrip()
    line = text[text.rfind("\n") + 1:].strip()
    if _open(text) or _MARK.match(line):
        return True
    if line.startswith("|"):
        rows = [x.strip() for x in text.split("\n") if x.strip().startswith("|")]
        return not line.endswith("|") or line.count("|") < rows[0].count("|")
    if text.endswith(("…", "...")):
        return True
    if text[-1] in _SENTENCE_END:
        return _BARE_NUMBER.search(line) is not None and re.search(r"\b(?:in|by|since|of|until|year|FY) ?(?:19|20)\d\d\.$", line) is None
    if _LABEL.match(line) or text[-1] in ")]}）」”`\"'":
        return False
    if text[-1] in ",:;·-–—/(":
        return True
    words = [_mask(w.rstrip(_SENTENCE_END)) for w in re.split(r"(?<=[.!?。])\s+", line)[-1].split()]
    for context in contexts(words):
        if context in terminal:
            return terminal[context] < TERMINAL
    return True


def terminal_contexts(outputs: DataFrame) -> dict[str, float]:
    """Share of sentence ends of every context frequent enough, over the column ``output``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        every: Counter[str] = Counter()
        ends: Counter[str] = Counter()

        def out() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(list(every), pa.string()), pa.array(list(every.values()), pa.int64()), pa.array([ends[c] for c in every], pa.int64())], ["context", "n", "ends"])
            every.clear()
            ends.clear()
            return batch

        for batch in batches:
            for text in batch.column(0).to_pylist():
                every[""] += 1
                for context, end in events(text):
                    every[context] += 1
                    ends[context] += end
            if len(every) > 300_000:
                yield out()
        yield out()

    counted = fit_parallelism(outputs.where("output is not null").select("output")).mapInArrow(run, "context string, n long, ends long")
    total = materialize(counted.groupBy("context").agg(F.sum("n").alias("n"), F.sum("ends").alias("ends")), "terminal-contexts")
    texts = int(total.where("context = ''").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0])
    kept = total.where((F.col("context") != "") & (F.col("n") >= max(LEAST, KEEP * texts))).toPandas()
    return dict(zip(kept["context"], kept["ends"] / kept["n"], strict=True))


def defect(prompt: str | None, output: str | None, terminal: dict[str, float]) -> str | None:
    """The defect of a pair: empty, copy, language, refusal, truncated, or None; the first that fits."""
    if is_empty(output):
        return "empty"
    if is_copy(prompt, output):
        return "copy"
    if wrong_language(prompt, output):
        return "language"
    if is_refusal(output):
        return "refusal"
    return "truncated" if is_truncated(output, terminal) else None


def defects(steps: DataFrame) -> DataFrame:
    """(id, defect) of every defective pair among steps of type llm.

    Repeated rows count once, of differing ones the first by input and output.
    A null output is empty; a null input can neither be copied nor fix a
    language.  Rows without id are left out, an empty table gives no rows.
    """
    pairs = (
        steps.where("type = 'llm' and id is not null").groupBy("id")
        .agg(F.min(F.struct("input", "output")).alias("p")).select("id", "p.input", "p.output")
    )
    pairs = materialize(pairs, "pairs")
    model = pairs.sparkSession.sparkContext.broadcast(terminal_contexts(pairs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terminal = model.value
        for batch in batches:
            ids, prompts, outputs = (c.to_pylist() for c in batch.columns)
            kinds = [defect(p, o, terminal) for p, o in zip(prompts, outputs, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([i for i, k in zip(ids, kinds, strict=True) if k], pa.string()), pa.array([k for k in kinds if k], pa.string())], ["id", "defect"])

    return fit_parallelism(pairs).mapInArrow(run, "id string, defect string")
