"""Template residue, filler, error pages and script notices standing where content should be.

A text is read as the slug of its address (the source it came from), its title (an HTML title, or a
first line that is no sentence) and the passages of its body.  Two kinds of evidence are combined:

* Placeholder detectors go by form: slots in any usual brackets, error objects, and words made like
  those of the printers' filler text in a passage without function words.
* Notice passages: most terms of a passage belong to the vocabulary of system responses (``TERMS``),
  so it has little information of its own.  Where that alone does not decide, the rest of the
  record and the other records do: the passage shares no term with slug, title and other passages
  (mismatch), and the same passage without its numbers is delivered in several records (copies).
  So is a whole body of few terms that shares none with its title or slug.

Quoted wording is taken out first, and a sentence about notices has mostly terms of another kind.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scoreloom.session import checkpointed

SLOT = re.compile(
    r"\{\{\s*[\w. ]+?\s*\}\}|\$\{\s*[\w. ]+?\s*\}|\{[a-z_][\w.]*\}|\[\[\s*[\w. ]+?\s*\]\]|<<\s*[\w. ]+?\s*>>|«[^»\n]{1,40}»|(?<!\w)__[a-z][\w. ]*?__(?!\w)"
    r"|%%[\w. ]+?%%|@@[\w. ]+?@@|(?<!\w)#[a-z][\w.]*#|\[(?:your|insert|enter|add)\b[^\]\n]*\]|\[[^\]\n]{2,40} here\]|_{4,}|\$x+(?:,x+)+|\bxx/xx/xxxx\b|\[object object\]|\*\|[\w. ]+?\|\*"
    r"|<(?!/?(?:html|head|title|body|noscript|script|style|think|error|code|message|id|br|p|b|i|u|em|div|span|a|ul|li|table|tr|td|h\d)\b)[a-z_]+(?:[._ ][a-z]+)*>",
)
# Every slot holds one of these.
SLOT_KEYS = ["{", "[", "<", "«", "__", "%%", "@@", "#", "$x", "xx/", "*|"]
# Slots that say of themselves what is missing; rules, tags and braces alone may be layout or code.
LONE = re.compile(r"\W{0,3}(?:\{\{\s*[\w. ]+?\s*\}\}|\$\{\s*[\w. ]+?\s*\}|\[\[\s*[\w. ]+?\s*\]\]|<<\s*[\w. ]+?\s*>>|%%[\w. ]+?%%|@@[\w. ]+?@@|\[(?:your|insert|enter|add)\b[^\]\n]*\]|\[[^\]\n]{2,40} here\]|\*\|[\w. ]+?\|\*)\W{0,3}")
# Words by which a sentence speaks of slots as such.
NAMED = re.compile(r"\b(?:templates?|placeholders?|fields?|curly braces|the word)\b")
ERROR_OBJECT = re.compile(r"""(?:^|[\n>]|[.!?。]\s)\s*(?:\{\s*"(?:status|error|code)"\s*:\s*(?:"error|"fail|true|[45]\d\d)|<error>\s*<code>)""")
# Function words, which say nothing about a passage (fixed values).
COMMON = frozenset(
    "a an the this that these those it its is are was were be been being am do does did has have had having will would can could may might must shall should not no nor of to in on at by for with from into onto out off up down over under about as or and but if then than so such"
    " there here where when which who whom whose what how why i me my we us our you your he him his she her they them their one some any all each every other more most very too many much few also only just now yet still again before after while during until once because cannot can't couldn't don't doesn't won't isn't aren't we're we'll it's you're"
    " el la los las un una unos unas de del al que en y o u no se su sus con por para es son era fue ser esta este esto lo le les si como más pero".split()
)
# The vocabulary of system responses and of placeholder wording, by what it speaks of (fixed values).
TERMS = frozenset(
    # protocol and server
    "http error errors status code request requested requests response bad gateway gateways server service temporarily unavailable internal forbidden unauthorized denied access permission timeout timed upstream url link broken found exist exists moved removed gone blocked reset closed lost connection network host reference incident maintenance overloaded limit slow try retry later oops sorry wrong failed failure fatal exception traceback recent call last keyerror valueerror typeerror nginx apache asked search seems unusual traffic detected systems prove"
    # pages, viewers and sessions
    " page pages website web loading load loaded reload refresh redirected back home viewer view viewing read open opened display displayed show shown retrieved retrieve document documents attachment file files content available region session expired log login sign signed account learn help continue contact administrator support"
    # browsers and scripts
    " browser browsers javascript script scripts scripting noscript cookies cookie enable enabled enabling disable disabled allow allowed allowing activate activated turn turned switch switched supported unsupported outdated date update updated upgrade version use another looks required requires require need needs needed automatic automatically checking check process takes long seconds wait please something features feature properly robot captcha human verify html head title body"
    # placeholder wording
    " text dummy sample placeholder lorem ipsum goes go replace delete line paragraph description section written write insert enter fill added add todo tbd tba coming soon follow follows supply provide owner sending test testing blah asdf qwerty xxx xxxx summary untitled"
    # Spanish
    " página páginas encontrada encontrado encontró existe error servidor servicio solicitud solicitada inténtelo intente nuevamente nuevo tarde navegador navegadores active activar activado habilite cookies acceso denegado permiso sesión caducado expirado cargar cargando cargue recargue actualice versión compatible continuar necesario ver escriba aquí texto ejemplo reemplace disponible contenido documento abrir".split()
)
# Those of the terms that hardly stand in other texts; a passage needs one of them.
CORE = frozenset(
    "http requests retry error errors gateway server unavailable forbidden unauthorized denied permission timeout timed url gone blocked reset connection oops exception traceback page website loading reload refresh viewer retrieved opened displayed available region session expired login browser browsers javascript script scripts scripting noscript cookies cookie captcha robot"
    " placeholder dummy lorem todo tbd tba goes delete soon written follow supply blah asdf qwerty xxx xxxx página encontrada encontrado servidor navegador javascript acceso denegado sesión caducado expirado aquí reemplace disponible".split()
)
HAN_TERMS = re.compile("页面|网页|未找到|不存在|找不到|服务器|错误|浏览器|脚本|启用|开启|版本过低|不支持|升级|更新|在此处|此处|输入|正文|内容|文本|请求|请|稍后|再试|重试|刷新|无法|访问|登录|重新|已过期|过期|会话|超时|连接|加载|显示|打开|查看|继续|文件|验证|需要|禁用|待补充|占位|示例|代码|返回|首页|您的|的|您|了|此|后|并|以|或")
HAN_CORE = re.compile("|".join(w for w in HAN_TERMS.pattern.split("|") if len(w) > 1))
# Words of the printers' filler text (fixed values); made-up filler varies their endings.
FILLER_WORDS = "lorem ipsum dolor amet consectetur adipiscing elit eiusmod tempor incididunt labore dolore magna aliqua enim minim veniam quis nostrud exercitation ullamco laboris nisi aliquip commodo consequat duis aute irure reprehenderit voluptate velit esse cillum fugiat nulla pariatur excepteur sint occaecat cupidatat proident sunt culpa officia deserunt mollit anim laborum mauris tellus vulputate ornare fermentum pellentesque quam ante nec sed viverra tincidunt sagittis vestibulum"
FILLER = frozenset(w[:4] for w in FILLER_WORDS.split())
STATUS = re.compile(r"\W{0,3}(?:http )?(?:error )?[45]\d\d\b")
REPEATED = re.compile(r"(?<!\w)([^\W\d_]{3,})(?:[\W_]{1,3}\1\b){2,}")
QUOTED = re.compile(r"(?<!\w)'[^'\n]{1,200}'(?!\w)|\"[^\"\n]{1,200}\"|“[^”\n]{1,200}”|‘[^’\n]{1,200}’|`[^`\n]{1,200}`")
PASSAGE = re.compile(r"(?<=[.!?。！？])(?:\s+|(?=[一-鿿]))|[\n\r  \x0b\x0c]+|\s*</(?:title|head|body|p|h\d)>\s*|\s*<(?:html|head|title|body|p|h\d)>\s*")
WORD = re.compile(r"(?<![\w#/])[^\W\d_]+(?:['’][a-z]+)?(?![\w/])")
LETTERS = re.compile(r"[^\W\d_]+")
PLAIN = TERMS | COMMON
HAN = re.compile(r"[一-鿿]")
SLOTS = 2  # unquoted slots that make a text an unfilled template; one is enough where it is the whole passage
DENSE, WEAK = 0.6, 0.5  # shares of response terms in a passage: enough, and enough with other evidence
LEAST_TERMS = 3  # different response terms in dense passages that need no other evidence
POOR = 12  # different terms of a body with little information
COPIES = 3  # records of a masked passage or body that count as evidence


def terms(passage: str) -> list[str]:
    """Words of a lower-case passage that are no function words; names of fields and numbers are none."""
    return [w for w in WORD.findall(passage) if w not in COMMON and not HAN.search(w)]


def density(passage: str) -> tuple[float, set[str]]:
    """(share of response terms, those terms) of a lower-case passage; Chinese counts by characters."""
    han = len(HAN.findall(passage))
    own = terms(passage)
    hits = {w for w in own if w in TERMS or w.removesuffix("s") in TERMS}
    told = sum(w in hits for w in own)
    if han >= 4:
        found = HAN_TERMS.findall(passage)
        hits |= {w for w in found if len(w) > 1}
        return (sum(map(len, found)) + told) / (han + len(own)), hits
    return (told / len(own) if own else 0.0), hits


def filler(passage: str) -> bool:
    """A response term three times over, or words made like those of the filler text without function words."""
    again = REPEATED.search(passage)
    if again and again[1] in TERMS:
        return True
    w = re.findall(r"[^\W\d_]{3,}", passage)
    return len(w) >= 5 and len({x[:4] for x in w} & FILLER) >= 3 and not COMMON.intersection(w)


def signs(text: str, slug: str | None) -> tuple[list[str], str]:
    """(kinds of residue that need no other evidence, a passage or body that does).

    The passage is masked: without numbers and everything that holds a digit.
    """
    kinds: set[str] = set()
    low = text.lower()
    if ("{" in low or "<error" in low) and ERROR_OBJECT.search(low):
        kinds.add("error")
    seen = set(LETTERS.findall(low))
    slotted = any(k in low for k in SLOT_KEYS) and SLOT.search(low)
    if not slotted and not CORE & seen and "not found" not in low and not HAN_CORE.search(low) and not seen <= PLAIN and len({w[:4] for w in seen} & FILLER) < 3:
        return sorted(kinds), ""  # none of the detectors below can fire
    low = QUOTED.sub(" ' ", low)
    passages = [p.strip() for p in PASSAGE.split(low) if p and p.strip()]
    if slotted:
        slots = 0
        for p in passages:
            if LONE.fullmatch(p):
                kinds.add("template")
            elif not NAMED.search(SLOT.sub(" ", p)):
                slots += len(SLOT.findall(p)) + len(re.findall(r"\b(?:undefined|nan)\b", p))
        if slots >= SLOTS:
            kinds.add("template")
    dense: set[str] = set()
    best, weak, others = 0.0, -1, 0
    for i, p in enumerate(passages):
        if filler(p):
            kinds.add("filler")
        share, hits = density(p)
        core = any(w in CORE or HAN.search(w) for w in hits) or "not found" in p
        if share >= DENSE:
            dense |= hits
            if core and STATUS.match(p):
                kinds.add("error")
        elif terms(p) or HAN.search(p):
            others += 1
        if core and share >= WEAK and share * len(hits) > best:
            best, weak = share * len(hits), i
    # Enough of the response terms, or a text of nothing else.
    core = any(w in CORE or HAN.search(w) for w in dense) or "found" in dense and "not found" in low
    if core and (len(dense) >= LEAST_TERMS or not others) or len(dense) > LEAST_TERMS and not others:
        kinds.add("notice")
    if kinds:
        return sorted(kinds), ""
    address = terms((slug or "").lower().replace("-", " "))
    if weak >= 0:
        # Mismatch: no term of the passage that is not of a response stands in slug, title or elsewhere in the body.
        own = {w for w in terms(passages[weak]) if w not in TERMS}
        rest = {w for j, p in enumerate(passages) if j != weak for w in terms(p)} | set(address)
        return [], "" if own & rest else _masked(passages[weak])
    # A poor body that has a response term and shares no term with title and slug.
    lines = [x for x in low.split("\n") if x.strip()]
    title = terms(lines[0]) if len(lines) > 1 and not re.search(r"[.!?。]\s*$", lines[0]) else []
    body = set(terms("\n".join(lines[1:]) if title else low))
    if CORE & body and len(body) <= POOR and not body.intersection(title or address):
        return [], _masked(low)
    return [], ""


def _masked(passage: str) -> str:
    return " ".join(w for w in passage.split() if not re.search(r"\d", w))


def find_residue(df: DataFrame, key: str, text: str, slug: str) -> DataFrame:
    """(key, kinds): the texts that are, or hold, residue in place of content.

    Null, empty and blank texts are no cases; a null slug is an empty one.  Repeated rows are each
    reported and count together as host evidence.  Whole texts are read, whatever their length.
    An empty table gives an empty result; other columns are not read.
    """
    kind = df.schema[key].dataType.simpleString()

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = []
            for k, t, s in zip(part["k"], part["t"], part["s"]):
                kinds, weak = signs(t, s)
                if kinds or weak:
                    rows.append((k, kinds, weak or None))
            yield pd.DataFrame(rows, columns=["k", "kinds", "masked"])

    source = df.select(F.col(key).alias("k"), F.col(text).alias("t"), F.lower(F.trim(F.col(slug))).alias("s")).where(r"t IS NOT NULL AND t RLIKE '\\S'")
    # Read three times below, and few rows: kept in the shared folder, so texts are read once.
    found = checkpointed(source.mapInPandas(run, f"k {kind}, kinds array<string>, masked string"))
    # One row for each masked passage and task reaches the shuffle; copies are counted, never gathered.
    weak = found.where("masked IS NOT NULL")
    copied = weak.groupBy("masked").count().where(F.col("count") >= COPIES).select("masked")
    evident = weak.join(copied, "masked", "left_semi").select("k", F.array(F.lit("host evidence")).alias("kinds"))
    return found.where("masked IS NULL").select("k", "kinds").unionByName(evident).withColumnRenamed("k", key)
