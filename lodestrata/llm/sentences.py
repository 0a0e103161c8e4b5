"""Problem 9: sentence units in many languages and scripts, in SQL expressions only.

Points that end no sentence (in decimals and host names, after initials, abbreviations, ordinals and list numbers, and
within a quotation whose attribution follows) are masked by private-use characters of the same length; then a private-use
mark is put wherever the terminators of a script end a unit; the text is split at the marks. As every step keeps or adds
whole characters, the units' places are sums of lengths, and the original text is cut at them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.store import table

#: Abbreviations before a name (fixed values): the point after them ends no sentence.
BEFORE_NAMES = (
    "Dr", "Prof", "Mr", "Mrs", "Ms", "St", "Rev", "Gen", "Col", "Capt", "Lt", "Sgt", "Gov", "Sen", "Rep", "Hon", "Mt", "Messrs",
    "Hr", "Fr", "Frl", "Hrn", "Dipl", "Ing", "Mag", "vgl", "bzw", "ca", "sog", "evtl", "ggf", "inkl", "insb",
    "Mme", "Mlle", "Mgr", "Me", "env", "av", "boul", "cf", "éd", "chap",
    "Sr", "Sra", "Srta", "Dra", "Dña", "Ud", "Uds", "Exmo", "Exma", "Lic", "Profa", "Eng",
    "см", "ср", "др-р", "проф", "акад", "гр", "им", "ул", "пл", "пос", "обл", "руб", "тыс", "млн", "т", "гос",
    "mgr", "inż", "hab", "ks", "ul", "al", "św", "zob", "por", "płk", "gen",
    "डॉ", "श्री", "प्रो", "पं", "कु", "δρ", "κος", "κα", "βλ", "πχ", "καθ", "αγ", "viz", "vs",
)
#: Abbreviations before a number (fixed values).
BEFORE_NUMBERS = (
    "no", "nos", "nr", "vol", "vols", "pp", "pág", "págs", "pag", "fig", "sec", "art", "ch", "bd", "abb", "kap", "jg", "hft", "núm",
    "num", "cap", "tom", "str", "рис", "гл", "стр", "табл", "вып", "кн", "αρ", "σελ", "τόμ", "τ", "approx", "ca", "est", "bl", "tab", "anm", "reg.-nr",
)
#: Months that follow a day's ordinal (fixed values).
MONTHS = ("Januar", "Jänner", "Februar", "März", "April", "Mai", "Juni", "Juli", "August", "September", "Oktober", "November", "Dezember")

#: Abbreviations that may end a sentence or not (fixed values); only told apart by the case of what follows.
OPEN_ENDED = ("etc", "usw", "др", "dgl", "ltd", "inc", "co", "и т")

WS = r"[\s   -     　]"
POINT, MARK = "\ue000", "\ue010"
_TERMS = r"[.!?…؟۔।॥]"
#: Any number of closing marks; among them up to twelve that could open as well, or stand apart.
_CLOSERS = rf"[”’»\"')\]›]*+(?:(?:“(?={WS}|[,;:]|$)|{WS}[»”›](?={WS}|[,;:.]|$))[”’»\"')\]›]*+){{0,12}}"
_OPEN = r"[“„«‘‚\"'‹]"
_NEXT = (
    rf"(?={WS}+(?:[\p{{Lu}}\p{{Lt}}\p{{Lo}}\p{{N}}¿¡]|{_OPEN}{WS}?[\p{{L}}\p{{N}}¿¡]"
    rf"|[(\[][\p{{Lu}}\p{{Lo}}\p{{N}}¿¡]|[—–-]{WS}?[¿¡\p{{Lu}}«“„]))"
)
_EAST = r"[。！？｡]"
_THAI = r"[฀-๿]"

_NAMES = "|".join((*BEFORE_NAMES, *(x.upper() for x in BEFORE_NAMES if len(x) > 2)))
_NUMBERS = "|".join(x.replace(".", "[.]") for x in BEFORE_NUMBERS)
_MONTHS = "|".join(MONTHS)

#: A point that ends no sentence. It is matched first and what stands before it by lookbehind, so that the engine passes
#: over all other characters: between letters or digits (decimals, versions, host and file names); after the number of a
#: list item; after initials and other single letters and abbreviations before names; before numbers; after a day.
POINTS = (
    r"\.(?:(?=[\p{L}\p{N}])(?<=[\p{L}\p{N}]\.)"
    r"|(?=[ \t])(?<=(?:^|\n)[ \t]{0,8}\p{N}{1,3}\.)"
    rf"|(?<=(?<![\p{{L}}\p{{N}}\p{{M}}])(?:\p{{L}}|{_NAMES})\.)"
    rf"|(?={WS}*\p{{N}})(?<=(?<![\p{{L}}\p{{N}}\p{{M}}])(?i:{_NUMBERS})\.)"
    rf"|(?={WS}+(?i:{_MONTHS})\b)(?<=(?<!\p{{N}})\p{{N}}{{1,2}}\.))"
)
#: A quotation that begins a sentence, in scripts without case: its attribution follows.
QUOTATION = (
    rf"((?:^|[\n.!?؟।。！？][”’»」]?){WS}*(?:[“«\"][^“”«»\n\"]++(?=[”»\"]{WS}?\p{{Lo}})|「[^「」\n]++(?=」{WS}?\p{{Lo}})|『[^『』\n]++(?=』{WS}?\p{{Lo}})))(?<={_TERMS}|{_EAST})"
)
#: Its terminator is marked first and then replaced, so that a quotation may be of any length.
QUOTED = rf"(?:{_TERMS}|{_EAST})\ue002"
#: A list item's number far to the right, which the lookbehind of POINTS does not reach.
FAR_ITEMS = r"((?:^|\n)[ \t]{9,}+\p{N}{1,3})\.(?=[ \t])"
#: Where a unit ends: after terminators and what closes with them, before blank lines and list items, at Thai spaces.
BREAKS = (
    r"(?=[.!?…؟۔।॥;;。！？｡\n \t])(?:"
    rf"({_TERMS}+{_CLOSERS}){_NEXT}|([;;](?<=\p{{IsGreek}}[;;]){_CLOSERS})(?={WS}+[\p{{Lu}}«“])|({_EAST}+[」』”’）》】)]*)(?!と)"
    rf"|(?=\n[ \t]*\n)|(?=\n[ \t]*(?:[-*•‣◦·–—][ \t]|\p{{N}}{{1,3}}[{POINT})][ \t]))|(?<={_THAI})(?=[ \t]+{_THAI}))"
)
#: The same for texts in Latin or Cyrillic letters only, which is most of them: the classes of characters are smaller.
SIMPLE_BREAKS = rf"([.!?…]+{_CLOSERS}){_NEXT}|(?=\n)(?:(?=\n[ \t]*\n)|(?=\n[ \t]*(?:[-*•‣◦·–—][ \t]|\p{{N}}{{1,3}}[{POINT})][ \t])))"
OTHER_SCRIPTS = r"[\u0370-\u03ff\u0590-\u1fff\u2c00-\ud7ff\uf900-\uffef]"
#: In a text all in small letters the case of what follows tells nothing.
SMALL_POINTS = rf"\.(?={WS}+\p{{Ll}})(?<=(?<![\p{{L}}\p{{N}}\p{{M}}])(?:{'|'.join((*OPEN_ENDED, *(x.lower() for x in BEFORE_NAMES if len(x) > 1)))})\.)"
SMALL_BREAKS = rf"([.!?]+)(?={WS}+[\p{{Ll}}])"
#: Units whose offsets are added up at once.
PART = 128
_BLANK = " \t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\xa0               　"


def with_spans(rows: DataFrame, text: str, spans: str) -> DataFrame:
    """``rows`` with an array of (start_char, end_char): code points from 0, the end exclusive. What is used twice is a
    column of its own, so that it is computed once."""
    rows = rows.withColumn("_small", ~F.col(text).rlike(r"\p{Lu}") & F.col(text).rlike(r"\p{Ll}"))
    rows = rows.withColumn("_other", F.col(text).rlike(OTHER_SCRIPTS))
    own = F.when(F.col(text).rlike("[\ue000-\ue010\r]"), F.translate(text, "\ue000\ue001\ue002\ue010\r", "???? ")).otherwise(F.col(text))
    masked = F.regexp_replace(own, POINTS, POINT)
    masked = F.when(F.col(text).rlike(r"\t[ \t]|[ \t]{9}"), F.regexp_replace(masked, FAR_ITEMS, f"$1{POINT}")).otherwise(masked)
    quoted = F.regexp_replace(F.regexp_replace(masked, QUOTATION, "$1\ue002"), QUOTED, "\ue001")
    masked = F.when(F.col("_other"), quoted).otherwise(masked)
    small = F.regexp_replace(F.regexp_replace(masked, SMALL_POINTS, POINT), SMALL_BREAKS, f"$1{MARK}")
    rows = rows.withColumn("_masked", F.when(F.col("_small"), small).otherwise(masked))
    full = F.regexp_replace("_masked", BREAKS, f"$1$2$3{MARK}")
    marked = F.when(F.col("_other"), full).otherwise(F.regexp_replace("_masked", SIMPLE_BREAKS, f"$1{MARK}"))
    sizes = F.transform(
        F.split(marked, MARK),
        lambda x: F.struct(F.length(x).alias("whole"), F.length(F.ltrim(x, F.lit(_BLANK))).alias("left"), F.length(F.rtrim(x, F.lit(_BLANK))).alias("right")),
    )
    rows = rows.withColumn("_sizes", sizes)
    # offsets in two levels, as appending to an array copies it
    rows = rows.withColumn("_parts", F.transform(F.sequence(F.lit(0), F.expr(f"(size(_sizes) - 1) div {PART}")), lambda k: F.slice("_sizes", k * PART + 1, PART)))
    whole = F.transform("_parts", lambda part: F.aggregate(part, F.lit(0), lambda a, x: a + x["whole"]))
    rows = rows.withColumn("_starts", _running(whole, F.lit(0), lambda x: x, lambda x, at: at))
    own = F.flatten(F.zip_with("_parts", "_starts", lambda part, at: _running(part, at, lambda x: x["whole"], lambda x, at: F.struct((at + x["whole"] - x["left"]).alias("start_char"), (at + x["right"]).alias("end_char")))))
    return rows.withColumn(spans, F.filter(own, lambda s: s["end_char"] > s["start_char"])).drop("_small", "_other", "_masked", "_sizes", "_parts", "_starts")


def _running(items: Column, start: Column, size: Callable[[Column], Column], out: Callable[[Column, Column], Column]) -> Column:
    """Of each item, ``out`` of it and the sum of the sizes before it."""
    none = F.filter(F.array(out(F.element_at(items, 1), start)), lambda x: F.lit(False))
    return F.aggregate(
        items,
        F.struct(start.alias("at"), none.alias("out")),
        lambda a, x: F.struct((a["at"] + size(x)).alias("at"), F.array_append(a["out"], out(x, a["at"])).alias("out")),
        lambda a: a["out"],
    )


def sentence_units(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, start_char, end_char): every unit of every text, without outer white space.

    Null and empty texts and texts of white space only have no units; a row that comes twice gives its units twice; rows
    with a null id are left out.
    """
    own = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).filter("id is not null and text is not null")
    # the outer form, as the optimizer would else put a filter on the array below and compute all of it once more for that
    return with_spans(own, "text", "spans").select("id", F.inline_outer("spans")).filter("start_char is not null")


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentence_units(table(spark, sf_dir, "documents"), "doc_id", "text").withColumnRenamed("id", "doc_id")


def p9_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The units with their text, cut from the original."""
    own = table(spark, sf_dir, "documents").filter("doc_id is not null and text is not null")
    rows = with_spans(own.select("doc_id", "text"), "text", "spans").select("doc_id", "text", F.inline_outer("spans")).filter("start_char is not null")
    return rows.select("doc_id", "start_char", F.expr("substring(text, start_char + 1, end_char - start_char)").alias("unit"))


QUERIES = {"p9_found": p9_found, "p9_units": p9_units}
