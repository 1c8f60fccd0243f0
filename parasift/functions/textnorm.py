"""Text normalisation as Column expressions: no Python runs when a query does.

Patterns carry ``(?U)`` wherever a class must know letters and white space beyond ASCII. Inputs of type
string; null gives null throughout.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
STOPWORDS = (
    "the a an of and or in on at to for with by is are was were be been being it its this that these those as from than "
    "then so if but not no yes we our you your he his she her they their i my me"
).split()
TOKEN_PUNCTUATION = ".,;:!?\"'()[]【】《》"
WORD_PUNCTUATION = ".,;:!?()[]\"'，。；：！？（）「」『』"
CN_PUNCTUATION = "：，。；！？（）【】“”《》、．"
EN_PUNCTUATION = ":,.;!?()[]\"\"<>,."
MONTHS = "January February March April May June July August September October November December".split()
CN_NUMERALS = "一二三四五六七八九十"
ROMAN_NUMERALS = "I II III IV V VI VII VIII IX X".split()
URL_CHAR = r"[^\s\u4e00-\u9fff\u3000-\u303f\uff00-\uffef]"
URL_TLDS = "com|cn|net|org|edu|gov|io"
URL_PATTERN = rf"https?://{URL_CHAR}+|www\.{URL_CHAR}+\.\w{{2,}}|[a-zA-Z0-9]{URL_CHAR}*\.(?:{URL_TLDS})(?!\w){URL_CHAR}*"
#: What each kind of URL cannot do without; quick to look for, whatever the length of a word.
URL_MARK = rf"https?://|www\.|\.(?:{URL_TLDS})(?!\w)"
INLINE_URL_PATTERN = rf"https?://{URL_CHAR}+|www\.{URL_CHAR}+\.\w{{2,}}"
#: A host name in a word of ASCII letters or digits, upper and lower case told apart. It is looked for from the word's
#: beginning only, so a word's length costs no square.
DOMAIN_PATTERN = rf"(?<![^ \t\n\f\r])[^ \t\n\f\ra-zA-Z0-9]*+[a-zA-Z0-9][^ \t\n\f\r]*\.(?:{URL_TLDS})(?![a-zA-Z0-9_])"
#: A word that is an address, in ASCII.
ADDRESS_PATTERN = r"(?<![^ \t\n\f\r])[a-zA-Z0-9_.+-]++@[a-zA-Z0-9_.-]++(?![^ \t\n\f\r])"
EMAIL_PATTERN = r"[\w.+-]+@[\w.-]+\.\w{2,}"
PROTECTED_TOKEN_PATTERNS = [
    r"\d[\d,.]*",
    r"[vV]\d+(\.\d+)+",
    r"[A-Z]{1,4}[-.]?\d[\d.-]*",
    r"[A-Za-z]+\d{4,}",
    r"\d+[A-Za-z][\w-]*",
    r"[\w.+-]+@[\w.-]+\.?",
    r"(?:https?://|www\.)[\w.%-]+\.\w{2,}.*",
    r"\[(?:Image|Seal|Barcode|Logo|Original)[^\]]*\]",
]
CJK = r"[\u4e00-\u9fff]"
TERM_ONLY_BLOCK = r"[\u4e00-\u9fff\uff00-\uffef\u3000-\u303f\u2018-\u201f]"
CN_LABELS = {
    "【图片】": "[Image]",
    "【照片】": "[Image]",
    "【图像】": "[Image]",
    "【条形码】": "[Barcode]",
    "【图标】": "[Logo]",
    "【盖章】": "[Seal]",
    "【英文材料无需翻译】": "[No Translation Required — Source Material in English]",
    "【英文材料，无需翻译】": "[No Translation Required — Source Material in English]",
    "【含越南语】": "",
    "【含越南文】": "",
    "【原文】": "[Original]",
    "电子邮箱": "Email",
    "电子邮件": "Email",
    "邮箱": "Email",
    "联系电话": "Contact Number",
    "电话": "Tel",
    "网址": "URL",
    "链接": "Link",
    "来源": "Source",
}
MODEL_REMARKS = [
    r"此段内容为[^，。\n]*，请提供需翻译的[^。\n]*[。]?",
    r"您提供的文本是[^，。\n]*，[^。\n]*[。]?",
    r"(?s)原文[：:]\s*.+?\s*翻译[：:]\s*",
]

_MONTH = f"(?:{'|'.join(MONTHS)})"
#: A day number without its leading zero in the group.
_DAY = r"(?:0(?=\d(?!\d)))?(\d{1,2})"


def substitute(text: Column, rules: list[tuple[str, str]]) -> Column:
    """Regular-expression replacements in order; ``$1`` is a group."""
    return reduce(lambda c, rule: F.regexp_replace(c, F.lit(rule[0]), F.lit(rule[1])), rules, text)


def literal(text: Column, pairs: list[tuple[str, str]]) -> Column:
    """Plain replacements in order."""
    return reduce(lambda c, pair: F.replace(c, F.lit(pair[0]), F.lit(pair[1])), pairs, text)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value`` computed once: within a lambda an expression is computed for each element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def where_seen(text: Column, seen: Callable[[Column], Column], rule: Callable[[Column], Column]) -> Column:
    """``rule`` of texts that a quick look ``seen`` says may change; others stay as they are."""
    return let(text, lambda t: F.when(seen(t), rule(t)).otherwise(t))


def names_month(text: Column) -> Column:
    return reduce(lambda a, b: a | b, (text.contains(m) for m in MONTHS))


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(r"(?U)\S+"), F.lit(0))


def is_stopword(token: Column) -> Column:
    return F.lower(token).isin(STOPWORDS)


def is_protected_token(token: Column) -> Column:
    """Numbers, versions, identifiers, e-mails, URLs, markers and blanks."""
    bare = F.regexp_replace(token, F.lit(r"(?U)^\s+|\s+$"), F.lit(""))
    return (bare == "") | bare.rlike("(?U)^(?:" + "|".join(PROTECTED_TOKEN_PATTERNS) + ")$")


def normal_token(token: Column) -> Column:
    return F.lower(F.btrim(token, F.lit(TOKEN_PUNCTUATION)))


def contains_url(text: Column) -> Column:
    return text.rlike(f"(?iu)(?:{URL_MARK})") & text.rlike(f"(?iu)(?:{URL_PATTERN})")


def has_domain(text: Column) -> Column:
    """Whether a word names a host under one of the known top-level domains; narrower than ``contains_url``."""
    return text.rlike(DOMAIN_PATTERN)


def addresses(text: Column) -> Column:
    """The e-mail addresses among the words between ASCII white space."""
    return F.regexp_extract_all(text, F.lit(ADDRESS_PATTERN), F.lit(0))


def url_parts(text: Column) -> tuple[Column, Column]:
    """What lies between a text's URLs (one more than those, maybe empty), and the URLs."""
    pattern = f"(?iu)(?:{URL_PATTERN})"
    return F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def url_stretches(text: Column) -> Column:
    """The text as an array of stretches (``part``, ``url``): what lies between URLs, and the URLs."""
    others, urls = url_parts(text)
    both = F.struct(others.alias("others"), urls.alias("urls"))
    stretch = lambda part, url: F.struct(part.alias("part"), F.lit(url).alias("url"))
    pairs = let(both, lambda b: F.flatten(F.transform(b["others"], lambda o, i: F.array(stretch(o, False), stretch(F.coalesce(F.get(b["urls"], i), F.lit("")), True)))))
    return F.filter(pairs, lambda x: x["part"] != "")


def chinese_residue(text: Column) -> Column:
    """Every character of the CJK block, in order, with repeats."""
    return F.regexp_extract_all(text, F.lit(CJK), F.lit(0))


def is_url_line(text: Column) -> Column:
    return contains_url(text) & (F.size(chinese_residue(text)) < 20)


def is_term_only(text: Column) -> Column:
    return (F.length(text) < 100) & ~text.rlike(TERM_ONLY_BLOCK)


def is_blank(text: Column) -> Column:
    return F.regexp_replace(text, F.lit(r"(?U)\s+"), F.lit("")) == ""


def route(text: Column, blank: Column | None = None, url: Column | None = None, term: Column | None = None) -> Column:
    """Which path of the translation a paragraph takes: blank, url, term or model. Conditions that are given stand in
    for the usual ones."""
    blank, url, term = (own if own is not None else usual(text) for own, usual in ((blank, is_blank), (url, is_url_line), (term, is_term_only)))
    return F.when(blank, "blank").when(url, "url").when(term, "term").when(text.isNotNull(), "model")


def is_sentence_like(value: Column) -> Column:
    """Glossary values that are sentences rather than names."""
    bare = F.regexp_replace(value, F.lit(r"(?U)^\s+|\s+$"), F.lit(""))
    body = F.regexp_replace(bare, F.lit(r"\.+$"), F.lit(""))
    dots = F.length(body) - F.length(F.replace(body, F.lit("."), F.lit("")))
    return (bare == "") | (F.length(bare) > 80) | (F.size(tokens(bare)) > 10) | (dots >= 2) | body.rlike("[!?;]")


def snippet(text: Column, limit: int = 80) -> Column:
    flat = F.btrim(F.regexp_replace(text, F.lit(r"(?U)\s+"), F.lit(" ")))
    return F.when(F.length(flat) <= limit, flat).otherwise(F.concat(F.rtrim(F.substring(flat, 1, limit)), F.lit("…")))


def html_escape(text: Column) -> Column:
    return literal(text, [("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")])


def normalize_quotes(text: Column) -> Column:
    """Double quotes, straight or curly, become an opening and a closing one in turn."""
    opened = F.split(F.translate(text, "“”", '""'), '"', -1)
    mark = lambda i: F.when(i == 0, "").when(i % 2 == 1, "“").otherwise("”")
    return F.array_join(F.transform(opened, lambda part, i: F.concat(mark(i), part)), "")


def cn_punctuation(text: Column) -> Column:
    return F.translate(text, CN_PUNCTUATION, EN_PUNCTUATION)


def double_dates(text: Column) -> Column:
    date = rf"(?<!\w)({_MONTH}\s+\d{{1,2}},\s+\d{{4}})"
    rules = [(rf"(?U){date}\s+\d{{4}}[-.]\d{{1,2}}[-.]\d{{1,2}}(?!\w)", "$1"), (rf"(?U){date}\s+\1(?!\w)", "$1")]
    return where_seen(text, names_month, lambda t: substitute(t, rules))


def normalize_dates(text: Column) -> Column:
    """Other English date orders and ordinals become ``Month D, YYYY``; ``RMB n yuan`` becomes ``RMB n``."""
    dates = [
        (rf"(?U)(?<!\w)({_MONTH})\s+(\d{{4}})\s+{_DAY}(?:st|nd|rd|th)?(?!\w)", "$1 $3, $2"),
        (rf"(?U)(?<!\w)({_MONTH})\s+{_DAY}(?:st|nd|rd|th),\s+(\d{{4}})(?!\w)", "$1 $2, $3"),
        (rf"(?U)(?<!\w){_DAY}\s+({_MONTH})\s+(\d{{4}})(?!\w)", "$2 $1, $3"),
    ]
    dated = where_seen(text, names_month, lambda t: substitute(t, dates))
    amount = (r"(?U)(?<!\w)RMB\s+([\d,]+\.?\d*)\s*(?:yuan|Yuan)(?!\w)", "RMB $1")
    return where_seen(dated, lambda t: t.contains("RMB"), lambda t: substitute(t, [amount]))


def punctuation_runs(text: Column) -> Column:
    """Two dots become one, more an ellipsis; runs of commas and a comma before a dot shrink."""
    dots = [(r"\.{3,}", "\u0000"), (r"\.\.", "."), ("\u0000", "...")]
    dotted = where_seen(text, lambda t: t.contains(".."), lambda t: substitute(t, dots))
    return where_seen(dotted, lambda t: t.contains(",,") | t.contains(",."), lambda t: substitute(t, [(r",{2,}", ","), (r",\.", ".")]))


def normalize_formats(text: Column) -> Column:
    return punctuation_runs(normalize_dates(text))


def collapse_char_runs(text: Column) -> Column:
    """Three or more of one word character become one, but for digits and Roman numeral letters."""
    # The repeat is looked for first: nearly every character fails there, and costs no look at its class.
    return F.regexp_replace(text, F.lit(r"(?U)(.)(?=\1\1)(?<=[\w&&[^\divxlcdmIVXLCDM]])\1+"), F.lit("$1"))


def split_camel(text: Column) -> Column:
    return F.regexp_replace(text, F.lit("([a-z])([A-Z])"), F.lit("$1 $2"))


def punctuation_spacing(text: Column) -> Column:
    return F.regexp_replace(text, F.lit("([.,;:!?])([A-Za-z])"), F.lit("$1 $2"))


def parenthesis_spacing(text: Column) -> Column:
    opened = where_seen(text, lambda t: t.contains("("), lambda t: substitute(t, [(r"(?U)\((?<=\w\()", " (")]))
    return where_seen(opened, lambda t: t.contains(")"), lambda t: substitute(t, [(r"(?U)\)(\w)", ") $1")]))


def single_spaces(text: Column) -> Column:
    return F.regexp_replace(text, F.lit(" {2,}"), F.lit(" "))


def before_dedup(text: Column) -> Column:
    """The steps of the segment clean-up before duplicate words are looked at."""
    return normalize_formats(double_dates(cn_punctuation(text)))


def after_dedup(text: Column) -> Column:
    """The steps after it; dates doubled by them go last."""
    spaced = parenthesis_spacing(punctuation_spacing(split_camel(collapse_char_runs(text))))
    spaced = where_seen(spaced, lambda t: t.contains("'s"), lambda t: substitute(t, [("([a-zA-Z])'s([A-Z])", "$1's $2")]))
    date = rf"(?<!\w)({_MONTH}\s+\d{{1,2}},\s+\d{{4}})"
    rule = (rf"(?U){date}\s+\d{{4}}[-.]\d{{1,2}}[-.]\d{{1,2}}(?!\w)", "$1")
    return where_seen(single_spaces(spaced), names_month, lambda t: substitute(t, [rule]))


def enumerations(text: Column) -> Column:
    """Chinese list markers become Roman ones; ``1、`` becomes ``1.``."""
    rules: list[tuple[str, str]] = []
    for numeral, roman in zip(CN_NUMERALS, ROMAN_NUMERALS):
        rules += [(rf"(?U)(?<!\S){numeral}、", f"{roman}."), (rf"(?U)(?<!\S)第{numeral}、", f"{roman}."), (rf"\({numeral}\)|（{numeral}）", f"({roman})")]
    return substitute(text, [*rules, (r"(?U)(?<!\S)([0-9])、", "$1.")])


def fix_cn_labels(text: Column) -> Column:
    """Labels in English, remarks of the model gone, list markers made Roman. Each of these rules needs a Chinese
    character or a Chinese comma, but for two names of images."""
    images = lambda t: literal(t, [("[Photo]", "[Image]"), ("[Picture]", "[Image]")])
    labelled = lambda t: substitute(literal(t, list(CN_LABELS.items())), [(p, "") for p in MODEL_REMARKS])
    return let(text, lambda t: F.when(t.rlike(r"[\u3001\u4e00-\u9fff]"), enumerations(images(labelled(t)))).otherwise(images(t)))


def convert_chinese_dates(text: Column) -> Column:
    """Chinese and numeric dates become English ones; impossible months stay.

    The month number goes between two private characters first, and those are then replaced by its name:
    five patterns and twelve plain replacements, only for texts that hold a date mark at all.
    """
    month = r"(?:0(?=[1-9]\D))?(1[0-2]|[1-9])"
    named = "\ue000{}\ue001"
    forms = [
        (rf"(\d{{4}})\s*年\s*{month}\s*月\s*{_DAY}\s*日", f"{named.format('$2')} $3, $1"),
        (rf"(\d{{4}})\s*年\s*{month}\s*月(?!\s*\d)", f"{named.format('$2')} $1"),
        (rf"(?<!\d){month}\s*月\s*{_DAY}\s*日", f"{named.format('$1')} $2"),
        (rf"(?<!\d)(\d{{4}})\.{month}\.{_DAY}(?!\d)", f"{named.format('$2')} $3, $1"),
        (rf"(?<!\d)(\d{{4}})-{month}-{_DAY}(?!\d)", f"{named.format('$2')} $3, $1"),
    ]
    dated = substitute(text, [("(?U)" + form, out) for form, out in forms])
    dated = literal(dated, [(named.format(m), name) for m, name in enumerate(MONTHS, 1)])
    dated = literal(dated, [("年 ", " "), ("月 ", " "), ("日 ", " ")])
    return F.when(text.rlike(r"[年月日]|\d{4}[.-]\d"), dated).otherwise(text)


def strip_markdown(text: Column) -> Column:
    return substitute(text, [(r"(?s)\*\*\*(.+?)\*\*\*", "$1"), (r"(?s)\*\*(.+?)\*\*", "$1"), (r"(?s)\*(.+?)\*", "$1")])


def strip_revision_tags(text: Column) -> Column:
    tag = r"\[REVISION_INSTRUCTION\]"
    cut = substitute(text, [(rf"(?s){tag}.*?\[/REVISION_INSTRUCTION\]", ""), (rf"(?s){tag}.*", "")])
    return F.regexp_replace(cut, F.lit(r"(?U)^\s+|\s+$"), F.lit(""))


def split_long(text: Column, limit: int = 400) -> Column:
    """Chunks of whole sentences, at most ``limit`` characters each; a longer sentence is cut, but not
    inside a guard token."""
    inside = r"(?<=_)_G\d{1,6}__|(?<=__)G\d{1,6}__|(?<=__G\d{0,5})\d{1,6}__|(?<=__G\d{1,6})__|(?<=__G\d{1,6}_)_"
    cut = lambda p: F.regexp_extract_all(p, F.lit(rf"(?s).{{1,{limit}}}(?!{inside})"), F.lit(0))
    parts = F.filter(F.split(text, "(?<=[。；！？!?])", -1), lambda p: p != "")
    pieces = F.flatten(F.transform(parts, lambda p: F.when(F.length(p) <= limit, F.array(p)).otherwise(cut(p))))
    fits = lambda acc, p: (F.size(acc) > 0) & (F.length(F.element_at(acc, -1)) + F.length(p) <= limit)
    grown = lambda acc, p: F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.concat(F.element_at(acc, -1), p)))
    packed = F.aggregate(pieces, F.array().cast("array<string>"), lambda acc, p: F.when(fits(acc, p), grown(acc, p)).otherwise(F.concat(acc, F.array(p))))
    return F.when(F.length(text) <= limit, F.array(text)).otherwise(packed)
