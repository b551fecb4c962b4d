"""Names, times and numbers in text."""

from __future__ import annotations

import sys
import unicodedata
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F


def clock(seconds: Column) -> Column:
    """h:mm:ss of the nearest second (half a second goes up), or m:ss under an hour."""
    s = F.floor(seconds + F.lit(0.5)).cast("long")
    h, m = F.floor(s / 3600).cast("long"), F.floor(s % 3600 / 60).cast("long")
    return F.when(h > 0, F.format_string("%d:%02d:%02d", h, m, s % 60)).otherwise(F.format_string("%d:%02d", m, s % 60))


def stamp(pts: Column, num: Column, den: Column) -> Column:
    """NNhNNmNNsNNN of a frame's time, in whole milliseconds."""
    ms = F.floor(pts * num * 1000 / den).cast("long")
    part = lambda by, of: F.floor(ms / by % of).cast("long")
    return F.format_string("%02dh%02dm%02ds%03d", F.floor(ms / 3_600_000).cast("long"), part(60_000, 60), part(1000, 60), ms % 1000)


def episode_code(n: Column) -> Column:
    return F.format_string("E%02d", n)


def label(*parts: Column) -> Column:
    return F.concat_ws(" · ", *[F.when(p != "", p) for p in parts])


@cache
def plain_letters() -> tuple[str, str, dict[str, str]]:
    """Characters that are one plain letter or digit under their marks, with those; and the ones that are several."""
    single, several = {}, {}
    for code in range(128, min(sys.maxunicode, 0xFFFF) + 1):
        c = chr(code)
        bare = "".join(x for x in unicodedata.normalize("NFKD", c) if not 0x300 <= ord(x) <= 0x36F).lower()
        bare = "".join(x if x.isascii() else " " for x in bare)
        if any(x.isalnum() for x in bare):
            (single if len(bare) == 1 else several)[c] = bare
    return "".join(single), "".join(single.values()), several


def bound(x: Column, f) -> Column:
    """f(x) with x computed once, however often f names it."""
    return F.transform(F.array(x), f)[0]


def plain_text(name: Column) -> Column:
    """Lower case, letters without their marks and in their plain form."""
    single, letters, several = plain_letters()
    table = F.create_map(*[F.lit(x) for pair in several.items() for x in pair])
    spelt = lambda low: F.array_join(F.transform(F.split(low, ""), lambda c: F.coalesce(F.element_at(table, c), c)), "")
    bare = F.translate(F.translate(F.lower(name), "".join(map(chr, range(0x300, 0x370))), ""), single, letters)
    other = bound(bare, lambda low: F.when(low.rlike("[" + "".join(several) + "]"), spelt(low)).otherwise(low))
    return F.when(F.octet_length(name) == F.length(name), F.lower(name)).otherwise(other)


def words_of(name: Column) -> Column:
    """The runs of a-z and 0-9 of a plain name; apostrophes part no word."""
    return F.filter(F.split(F.translate(plain_text(F.coalesce(name, F.lit(""))), "'\u2019", ""), "[^a-z0-9]+"), lambda w: w != "")


def slug(name: Column, most: int = 60) -> Column:
    """Words joined by dashes, no leading 'the' before another word, as many whole words as `most` letters hold."""
    start = F.struct(F.lit("").alias("text"), F.lit(False).alias("full"))

    def add(acc: Column, w: Column) -> Column:
        both = F.when(acc["text"] == "", F.substring(w, 1, most + 1)).otherwise(F.concat(acc["text"], F.lit("-"), w))
        full = acc["full"] | ((acc["text"] != "") & (F.length(both) > most))
        return F.struct(F.when(full, acc["text"]).otherwise(both).alias("text"), full.alias("full"))

    named = lambda words: F.when((F.size(words) > 1) & (F.get(words, F.lit(0)) == "the"), F.slice(words, 2, F.size(words))).otherwise(words)
    text = F.aggregate(bound(words_of(name), named), start, add)["text"]
    return bound(text, lambda t: F.when(t == "", "work").otherwise(t))


def cut_words(text: Column, most: Column, least: int = 1) -> Column:
    """A slug cut to `most` letters, at a word's end if `least` letters stay, else within a word."""
    head = F.substring(text, F.lit(1), most + 1)
    at_word = F.when(head.contains("-"), F.regexp_replace(head, "-[^-]*$", "")).otherwise("")
    cut = F.when(F.length(at_word) >= F.least(F.lit(least), most), at_word).otherwise(F.substring(text, F.lit(1), most))
    return F.when(F.length(text) <= most, text).otherwise(F.rtrim(cut, F.lit("-")))


def work_id(name: Column, kind: Column, number: Column, part: Column, most: int = 72) -> Column:
    """A slug; an episode adds its number, a film that is one of several parts its part (or the part's number).

    Where both do not fit, the name gives way first, to 24 letters, then the part, which then takes its number.
    """
    digits = number.cast("string")
    spare = F.when((F.coalesce(part, F.lit("")) != "") & number.isNotNull(), F.concat(F.lit("part-"), digits)).otherwise("")
    own = F.struct(slug(name).alias("base"), bound(F.array_join(words_of(part), "-"), lambda t: F.when(t == "", spare).otherwise(t)).alias("tail"))
    over = lambda base, tail: F.length(base) + 1 + F.length(tail) > most

    def shorten(x: Column) -> Column:
        room = F.greatest(F.lit(24), most - 1 - F.length(x["tail"]))
        return F.struct(F.when(over(x["base"], x["tail"]), cut_words(x["base"], room, 12)).otherwise(x["base"]).alias("base"), x["tail"].alias("tail"))

    def join(x: Column) -> Column:
        mark = F.coalesce(F.concat(F.lit("-"), digits), F.lit(""))
        cut = F.concat(cut_words(x["tail"], most - 1 - F.length(x["base"]) - F.length(mark)), mark)
        return F.concat(x["base"], F.lit("-"), F.when(over(x["base"], x["tail"]), cut).otherwise(x["tail"]))

    episode = F.concat(F.lit("-e"), F.when(number < 10, F.format_string("%02d", number)).otherwise(digits))
    film = lambda x: F.when(x["tail"] == "", x["base"]).otherwise(bound(bound(x, shorten), join))
    return bound(own, lambda x: F.when((kind == "episode") & number.isNotNull(), F.concat(x["base"], episode)).when(kind == "movie", film(x)).otherwise(x["base"]))


def guess_episode(name: Column) -> Column:
    """The episode number that a file name suggests, or null.

    The name without its ending and its bracketed parts is cut into words, blanks and single signs. A number counts as an
    episode by what stands before it, best first: a season mark (S01E05), a dash after a blank, an episode word, a #; else
    it is the one number that stands alone, is no part of a decimal and has no unit behind it.
    """
    stem = F.regexp_replace(F.regexp_replace(name, r"\.[^.]+$", ""), r"\[[^\]]*\]|\([^)]*\)", " ")
    cut = F.regexp_extract_all(F.lower(F.trim(stem)), F.lit(r"\s+|[\p{L}\p{N}_]+|[^\s\p{L}\p{N}_]"), F.lit(0))
    return bound(cut, numbered_part)


def numbered_part(parts: Column) -> Column:
    """The number of `guess_episode` from a name's parts, which are computed by now; only parts with a digit are looked at."""
    at = lambda i: F.coalesce(F.get(parts, i), F.lit(" "))
    blank, dash = (lambda t: t.rlike(r"^\s+$")), (lambda t: t.isin("-", "\u2013", "\u2014"))
    number = lambda t: t.rlike("^[0-9]{1,4}$")
    digits = lambda t: F.regexp_extract(t, "([0-9]{1,4})(?:v[0-9])?$", 1)
    words, units = ("e", "ep", "episode"), ("k", "p", "bit", "fps", "hz", "x")

    def behind(i: Column, test) -> Column:
        """Whether what stands before the part, at most one blank or dot apart, passes."""
        near = blank(at(i - 1)) | (at(i - 1) == ".")
        return test(at(i - 1)) | (near & test(at(i - 2))) | (blank(at(i - 1)) & (at(i - 2) == ".") & test(at(i - 3)))

    def place(i: Column) -> Column:
        t = at(i)
        season = t.rlike("^s[0-9]{1,2}e[0-9]{1,4}$") | (t.rlike("^e[0-9]{1,4}$") & blank(at(i - 1)) & at(i - 2).rlike("^s[0-9]{1,2}$"))
        dashed = t.rlike("^[0-9]{1,4}(v[0-9])?$") & ((dash(at(i - 1)) & blank(at(i - 2))) | (blank(at(i - 1)) & dash(at(i - 2)) & blank(at(i - 3)))) & (blank(at(i + 1)) | dash(at(i + 1)) | (at(i + 1) == "."))
        worded = t.rlike("^(e|ep|episode)[0-9]{1,4}$") | (number(t) & behind(i, lambda x: x.isin(*words)))
        hashed = number(t) & (at(i - 1) == "#") & (blank(at(i - 2)) | (i == 1))
        joined = (at(i - 1) == ".") | (at(i + 1) == ".")
        alone = number(t) & ~joined & ~at(i + 1).isin(*units) & ~(blank(at(i + 1)) & at(i + 2).isin(*units))
        rank = F.when(season, 1).when(dashed, 2).when(worded, 3).when(hashed, 4).when(alone, 5)
        return F.struct(rank.alias("rank"), i.alias("i"), digits(t).try_cast("int").alias("n"), alone.alias("alone"))

    every = F.filter(F.sequence(F.lit(0), F.greatest(F.size(parts) - 1, F.lit(0))), lambda i: at(i).rlike("[0-9]"))
    found = F.filter(F.transform(every, place), lambda x: x["rank"].isNotNull())
    told = lambda xs: F.struct(F.array_min(xs).alias("best"), (F.size(F.filter(xs, lambda x: x["alone"])) == 1).alias("only"))
    return bound(bound(found, told), lambda x: F.when((x["best"]["rank"] < 5) | x["only"], x["best"]["n"]))


#: Words of files that are no episodes; the numbered ones may end in a number.
EXTRA_WORDS = ("preview", "trailer", "menu", "extra", "extras", "bonus", "special", "ova", "oad", "recap", "omake", "creditless", "textless", "clean opening", "clean ending")
EXTRA_NUMBERED = ("ncop", "nced", "op", "ed", "pv", "cm")


def looks_extra(name: Column, words: tuple[str, ...] = EXTRA_WORDS, numbered: tuple[str, ...] = EXTRA_NUMBERED) -> Column:
    """Whether a file name has a word, or two words in a row, that mark what is no episode."""
    cut = F.filter(F.split(F.lower(F.regexp_replace(name, r"\.[^.]+$", "")), r"[^\p{L}\p{N}_]+"), lambda w: w != "")
    lists = lambda x, wanted: F.arrays_overlap(x, F.array(*map(F.lit, wanted)))

    def told(parts: Column) -> Column:
        pairs = F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda i: F.concat_ws(" ", F.get(parts, i - 1), F.get(parts, i)))
        bare = F.transform(parts, lambda w: F.regexp_replace(w, "[0-9]+$", ""))
        return lists(parts, words) | lists(pairs, words) | lists(bare, numbered)

    return bound(cut, told)


def natural_key(name: Column) -> Column:
    """A key whose plain order puts 'a2' before 'a10': numbers padded to ten digits."""
    padded = F.regexp_replace(F.lower(name), r"(\d+)", "0000000000$1")
    return F.regexp_replace(padded, r"0*(\d{10})(?!\d)", "$1")


def duration_seconds(text: Column) -> Column:
    """Seconds of 'h:m:s', 'm:s' or plain milliseconds."""
    p = F.split(text, ":")
    n = F.size(p)
    colon = F.when(n == 3, p[0].cast("double") * 3600 + p[1].cast("double") * 60 + F.get(p, F.lit(2)).cast("double")).when(n == 2, p[0].cast("double") * 60 + F.get(p, F.lit(1)).cast("double"))
    return F.when(text.contains(":"), colon).otherwise(text.try_cast("double") / 1000)


#: Words that a name is not sorted by.
ARTICLES = ("the", "a", "an")


def sort_name(name: Column) -> Column:
    """A name from its second word on if the first is an article and more follows."""
    words = F.split(name, r"\s+", 2)
    rest = F.get(words, F.lit(1))
    return F.when(F.lower(words[0]).isin(*ARTICLES) & (F.coalesce(rest, F.lit("")) != ""), rest).otherwise(name)


#: Names that a folder cannot have on some systems.
RESERVED = ("CON", "PRN", "AUX", "NUL", *(f"{d}{i}" for d in ("COM", "LPT") for i in range(1, 10)))


#: Signs that a folder's name cannot have.
REFUSED = '<>:"/\\|?*'


def folder_name(title: Column, most: int = 60) -> Column:
    """A title as one folder's name: its words (between blanks, dashes and refused or control signs) joined by dashes, cut to
    `most`, from its first to its last sign that is no dot, dash or blank."""
    between = "[" + "".join(f"\\x{ord(c):02x}" for c in REFUSED) + r"\p{Cntrl}\s-]+"
    cut = F.substring(F.array_join(F.split(title, between), "-"), 1, most)
    name = F.regexp_extract(cut, r"[^-. ](?:.*[^-. ])?", 0)
    return F.concat(name, F.when(F.array_contains(F.array(*map(F.lit, RESERVED)), F.upper(name)), "-x").otherwise(""))


def words_between(text: Column, between: str) -> Column:
    return F.filter(F.split(text, between), lambda w: w != "")


def clean_path(text: Column, most: int = 1000) -> Column:
    """The parts of a relative path, joined by slashes; null without a part, where one is a dot or two, if too long or with control signs."""
    parts = words_between(F.trim(text), r"[/\\]+")
    plain = F.forall(parts, lambda p: ~p.isin(".", "..")) & ~F.trim(text).rlike(r"\p{Cntrl}")
    return F.when((F.size(parts) > 0) & plain & (F.length(F.trim(text)) <= most), F.array_join(parts, "/"))


def clean_line(text: Column, most: int = 200) -> Column:
    """The words of a text with one blank between; null if that is too long."""
    line = F.array_join(words_between(text, r"[\s\p{Cntrl}]+"), " ")
    return F.when(F.length(line) <= most, line)
