"""Text columns: cleaning, composition, tokens, estimates, labels, templates."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .vectors import let

#: The labels that annotation ids stand for, in the order of their ids.
DEPARTMENTS = ["内科系统", "外科系统", "妇产儿科", "五官感官", "肿瘤与影像", "急诊与综合"]
CATEGORIES = ["疾病诊断类", "治疗方案类", "药物与用药安全类", "检查与检验类", "症状与体征类", "预防与保健类", "术后护理与康复类", "人群特异性健康类"]
UNKNOWN_DEPARTMENT, UNKNOWN_CATEGORY = "未知科室", "未知类别"
CUT_MARK = "\n...[内容已截断]\n"
DOUBT_MARK = "\n\n（内容可能不属实）"
EMPTY_MARK = "（空）"

TOKEN_BREAK = r"[^\p{L}\p{N}]+"
SPACE_ENDS = r"^\s+|\s+$"


def to_text(col: Column) -> Column:
    """Any value as a string, null as the empty one."""
    return F.coalesce(col.cast("string"), F.lit(""))


def strip(col: Column) -> Column:
    return F.regexp_replace(col, SPACE_ENDS, "")


def qa_text(source: Column, summary: Column, document: Column) -> Column:
    """The text of a record: question and answer for source ``qa``, else the document."""
    return F.when(source == "qa", F.concat(F.lit("问题: "), summary, F.lit("\n\n答案: "), document)).otherwise(document)


def content_key(summary: Column) -> Column:
    return F.md5(summary)


def strip_tags(html: Column) -> Column:
    return F.regexp_replace(html, "<[^>]*>", "")


def strip_thinking(text: Column) -> Column:
    return strip(F.regexp_replace(text, r"(?s)<think>.*?</think>\s*", ""))


def balanced_object(text: Column) -> Column:
    """From the first ``{`` to the ``}`` that closes it, every brace counted; empty where none does.

    Only the braces are looked at one by one: the text between them is measured as a whole.
    """
    rest = F.substring(text, F.instr(text, "{"), F.length(text))
    # pieces end with their brace; the fold carries (depth, characters so far, end of the object)
    pieces = F.regexp_extract_all(rest, F.lit(r"([^{}]*[{}])"), 1)
    start = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("at"), F.lit(0).alias("end"))

    def step(acc: Column, piece: Column) -> Column:
        depth = acc["depth"] + F.when(F.endswith(piece, F.lit("{")), 1).otherwise(-1)
        at = acc["at"] + F.length(piece)
        return F.struct(depth.alias("depth"), at.alias("at"), F.when((acc["end"] == 0) & (depth == 0), at).otherwise(acc["end"]).alias("end"))

    end = F.aggregate(pieces, start, step)["end"]
    return F.when(F.contains(text, F.lit("{")), F.substring(rest, F.lit(1), end)).otherwise(F.lit(""))


def fenced_json(text: Column) -> Column:
    """The body of the first json fence, else the first object with balanced braces, else the stripped
    text; empty where braces are open to the end."""
    fence = F.regexp_extract(text, r"(?s)```json\s*(.*?)\s*```", 1)
    return F.when(fence != "", fence).when(F.contains(text, F.lit("{")), balanced_object(text)).otherwise(strip(text))


def first_object(text: Column) -> Column:
    """The shortest ``{...}`` from the first brace, else the whole text."""
    found = F.regexp_extract(text, r"(?s)\{.*?\}", 0)
    return F.when(found != "", found).otherwise(text)


def tokens(text: Column, stop_words: list[str] | None = None) -> Column:
    """Lower-case runs of letters and digits in order, without stop words."""
    words = F.filter(F.split(F.lower(text), TOKEN_BREAK), lambda x: x != "")
    return F.filter(words, lambda x: ~x.isin(stop_words)) if stop_words else words


def counted(items: Column) -> Column:
    """An array of strings as array<struct<term, tf>> sorted by term: one sort, then the places where it changes."""

    def cut(s: Column) -> Column:
        n = F.size(s)
        firsts = F.filter(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: (i <= n) & ((i == 1) | (F.get(s, i - 1) != F.get(s, i - 2))))
        return let(firsts, lambda f: F.transform(f, lambda x, i: F.struct(F.get(s, x - 1).alias("term"), (F.coalesce(F.get(f, i + 1), n + 1) - x).cast("long").alias("tf"))))

    return let(F.sort_array(items), cut)


def cjk_grams(text: Column, n: int = 2) -> Column:
    """Character n-grams of runs of Han characters, for texts without blanks."""
    runs = F.regexp_extract_all(text, F.lit(r"(\p{IsHan}+)"), 1)
    return F.flatten(F.transform(runs, lambda r: F.transform(F.sequence(F.lit(1), F.greatest(F.length(r) - n + 1, F.lit(1))), lambda i: F.substring(r, i, F.lit(n)))))


def preview(text: Column, n: int = 200) -> Column:
    return F.substring(text, 1, n)


ESTIMATORS: dict[str, Callable[[Column], Column]] = {}


def estimator(name: str):
    """Registers a function of a text column that estimates its tokens."""

    def register(f: Callable[[Column], Column]) -> Callable[[Column], Column]:
        ESTIMATORS[name] = f
        return f

    return register


@estimator("chars")
def by_chars(text: Column) -> Column:
    return F.length(text)


@estimator("quarter")
def by_quarter(text: Column) -> Column:
    """A token for every four characters begun."""
    return F.ceil(F.length(text) / 4).cast("int")


@estimator("words")
def by_words(text: Column) -> Column:
    return F.size(tokens(text))


def estimate(text: Column, name: str = "quarter") -> Column:
    if name not in ESTIMATORS:
        raise ValueError(f"no estimator {name}")
    return ESTIMATORS[name](text)


TEMPLATES: dict[str, str] = {
    "answer": "Context:\n{context}\n\nQuestion: {question}\nAnswer:",
    "rewrite": "History:\n{history}\n\nRewrite as one question: {question}",
    "summary": "Summarise:\n{history}",
    "dialogue": "History:\n{history}\n\nContext:\n{context}\n\nQuestion: {question}\nAnswer:",
    "judge": "Documents:\n{context}\n\nQuestion: {question}\nAnswer: {answer}\nSupported?",
    "background": "Known: {background}\nSaid: {question}\nBackground:",
}


def register_template(name: str, text: str) -> None:
    """Adds a template, or replaces one."""
    TEMPLATES[name] = text


def template_names() -> list[str]:
    return sorted(TEMPLATES)


def template(name: str) -> str:
    """A registered template; an unknown name is the answer template."""
    return TEMPLATES.get(name, TEMPLATES["answer"])


def fill(text: str, **values: Column) -> Column:
    """A template with its ``{name}`` places filled by columns."""
    return reduce(lambda done, item: F.replace(done, F.lit("{" + item[0] + "}"), item[1]), values.items(), F.lit(text))


def label_names(ids: Column, names: list[str], unknown: str) -> Column:
    table = F.array(*map(F.lit, names))
    return F.transform(ids, lambda i: F.when((i >= 0) & (i < len(names)), F.get(table, i.cast("int"))).otherwise(F.lit(unknown)))


def numbered(docs: Column, head: str = "## 文档") -> Column:
    """An array of texts in rank order as one text with numbered heads."""
    return F.array_join(F.transform(docs, lambda x, i: F.concat(F.lit(head), (i + 1).cast("string"), F.lit("：\n"), x, F.lit("\n"))), "")


def last_numbered(docs: Column, most: int = 6) -> Column:
    """The last ``most`` texts, newest first, numbered from 1."""
    return numbered(F.slice(F.reverse(docs), 1, most))


def score_band(score: Column, high: float, middle: float) -> Column:
    return F.when(score >= high, "high").when(score >= middle, "middle").otherwise("low")
