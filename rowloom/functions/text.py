"""Text normalisation and name comparison as Spark expressions."""

from __future__ import annotations

import json
import re
import unicodedata
from functools import cache, reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from rowloom.functions.numbers import let

#: Characters that search ignores besides white space (fixed values).
IGNORED = "　・·･,，。./／()（）-–—_:：;；'\"「」『』【】[]"
#: Variant characters and what they fold to, in two directions that differ (fixed values).
SEARCH_VARIANTS = {"薮": "藪", "澤": "沢", "髙": "高", "﨑": "崎", "邉": "辺", "邊": "辺", "濵": "浜", "濱": "浜", "齋": "斎", "齊": "斉", "國": "国", "廣": "広", "神": "神"}
MATCH_VARIANTS = {"藪": "薮", "髙": "高", "﨑": "崎"}

_CLASS = r"(?U)[\s" + re.escape(IGNORED).replace("/", r"\/").replace('"', r"\"") + "]"
_WIDE = "".join(chr(c) for c in range(0xFF01, 0xFF5F))
_NARROW = "".join(chr(c) for c in range(0x21, 0x7F))
_KATAKANA = "".join(chr(c) for c in range(0x30A1, 0x30F7))
_HIRAGANA = "".join(chr(c - 0x60) for c in range(0x30A1, 0x30F7))


@cache
def _compatibility() -> tuple[str, str, dict[str, str], dict[str, str]]:
    """What compatibility normalisation makes of single characters, by rule from Unicode's data.

    Characters that become one other character and what they become, those that become
    several, and pairs of a character and a combining mark that become one.
    """
    single, several, pairs = {}, {}, {}
    for code in range(0x80, 0x2FA20):
        if 0xD800 <= code < 0xE000 or 0xAC00 <= code < 0xD7A4:
            continue
        char = chr(code)
        made = unicodedata.normalize("NFKC", char)
        if made != char:
            (single if len(made) == 1 else several)[char] = made
        parts = unicodedata.decomposition(char).split()
        if len(parts) == 2 and made == char:
            pairs["".join(chr(int(p, 16)) for p in parts)] = char
    return "".join(single), "".join(single.values()), several, pairs


def _class_of(chars: set[str], gap: int = 1) -> str:
    """A regular expression's class of the characters as ranges, over gaps below ``gap`` too: few ranges are tested fast."""
    codes, runs = sorted(map(ord, chars)), []
    for c in codes:
        if runs and c <= runs[-1][1] + gap:
            runs[-1][1] = c
        else:
            runs.append([c, c])
    return "[" + "".join(f"\\x{{{a:X}}}" if a == b else f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in runs) + "]"


def nfkc(text: Column) -> Column:
    """Compatibility normalisation, which Spark lacks.

    Native: one translation for characters that become one other, lookups for those that become
    several and for marks; marks that stand in another order and jamo that join are put together by rule, in texts that hold such alone. Texts without any of these, found by a coarse class, stay as they are.
    """
    single, made, several, pairs = _compatibility()
    marks = {p[1] for p in pairs}
    coarse = _class_of({*single, *several, *marks}, 64)

    def looked_up(t: Column, pattern: str, table: dict[str, str]) -> Column:
        found = F.array_distinct(F.regexp_extract_all(t, F.lit(pattern), F.lit(0)))
        of = F.from_json(F.lit(json.dumps(table, ensure_ascii=False)), "map<string,string>")
        return F.aggregate(found, t, lambda acc, c: F.replace(acc, c, F.coalesce(F.try_element_at(of, c), c)))

    def composed(t: Column) -> Column:
        return looked_up(t, f"(?s).{_class_of(marks)}", pairs)

    many, jamo = f"{_class_of(set(_marks()[0]))}{{2}}", "[\\x{1161}-\\x{1175}\\x{11A8}-\\x{11C2}]"
    # each step's result is bound once, as a plain reference would be computed anew at every use
    def _steps(text: Column) -> Column:
        return let(F.translate(text, single, made), lambda t: let(looked_up(t, _class_of(set(several)), several), lambda u: let(F.when(u.rlike(many), _stacked(u)).otherwise(u), lambda v: let(composed(v), composed))))

    plain = F.when(text.rlike(f"[\\x{{80}}-\\x{{10FFFF}}&&{coarse}]"), _steps(text)).otherwise(text)
    return F.when(text.rlike(jamo), _syllables(plain)).otherwise(plain)


#: Hangul: first leading consonant, vowel, trailing consonant less one, first syllable (fixed values of the standard).
JAMO = (0x1100, 0x1161, 0x11A7, 0xAC00)
_JAMO_RUN = r"(?:[\x{1100}-\x{1112}][\x{1161}-\x{1175}][\x{11A8}-\x{11C2}]?|[\x{AC00}-\x{D7A3}][\x{11A8}-\x{11C2}])"


def _syllables(text: Column) -> Column:
    """Joining jamo as the syllables that they form."""
    lead, vowel, trail, first = JAMO

    def code(run: Column, at: int) -> Column:
        return F.ascii(F.substring(run, at, 1))

    def joined(run: Column) -> Column:
        start = code(run, 1)
        open_ = F.when(start >= first, start).otherwise(((start - lead) * 21 + code(run, 2) - vowel) * 28 + first)
        last = F.when(F.length(run) == F.when(start >= first, 2).otherwise(3), F.ascii(F.right(run, F.lit(1))) - trail).otherwise(0)
        # a syllable that has a trailing consonant takes no other
        whole = F.decode(F.unhex(F.lpad(F.hex(open_ + last), 4, "0")), "UTF-16BE")
        return F.when((start >= first) & ((start - first) % 28 != 0), run).otherwise(whole)

    runs = F.array_distinct(F.regexp_extract_all(text, F.lit(_JAMO_RUN), F.lit(0)))
    return F.aggregate(runs, text, lambda acc, r: F.replace(acc, r, joined(r)))


@cache
def _marks() -> tuple[dict[str, int], dict[str, str]]:
    """Combining marks with their class, and what a character and a mark make together."""
    classes, made = {}, {}
    for code in range(0x110000):
        char = chr(code)
        if unicodedata.combining(char):
            classes[char] = unicodedata.combining(char)
        parts = unicodedata.decomposition(char).split()
        if len(parts) == 2 and not parts[0].startswith("<") and unicodedata.normalize("NFC", char) == char:
            made["".join(chr(int(p, 16)) for p in parts)] = char
    return classes, made


def _stacked(text: Column) -> Column:
    """Characters with two marks or more: marks in the order of their classes, joined where they make one character."""
    classes, made = _marks()
    several = f"(?s)(?:^|[^{_class_of(set(classes))[1:-1]}]){_class_of(set(classes))}{{2,}}"
    number = F.from_json(F.lit(json.dumps(classes, ensure_ascii=False)), "map<string,int>")
    whole = F.from_json(F.lit(json.dumps(made, ensure_ascii=False)), "map<string,string>")
    state = "struct<base:string,rest:string,last:int>"

    def step(acc: Column, mark: Column) -> Column:
        one = F.try_element_at(whole, F.concat(acc["base"], mark["m"]))
        joins = one.isNotNull() & (acc["last"] < mark["c"])
        return F.when(joins, F.struct(one.alias("base"), acc["rest"].alias("rest"), acc["last"].alias("last"))).otherwise(F.struct(acc["base"].alias("base"), F.concat(acc["rest"], mark["m"]).alias("rest"), mark["c"].alias("last"))).cast(state)

    def ordered(run: Column) -> Column:
        signs = F.filter(F.split(run, ""), lambda x: x != "")
        bare = F.try_element_at(number, F.get(signs, 0)).isNotNull()  # a text may begin with marks
        marks = F.array_sort(F.transform(F.when(bare, signs).otherwise(F.slice(signs, F.lit(2), F.size(signs))), lambda m, i: F.struct(F.try_element_at(number, m).alias("c"), i.alias("i"), m.alias("m"))))
        start = F.struct(F.when(bare, "").otherwise(F.get(signs, 0)).alias("base"), F.lit("").alias("rest"), F.lit(0).alias("last")).cast(state)
        return let(F.aggregate(marks, start, step), lambda s: F.concat(s["base"], s["rest"]))

    runs = F.array_distinct(F.regexp_extract_all(text, F.lit(several), F.lit(0)))
    return F.aggregate(runs, text, lambda acc, r: F.replace(acc, r, ordered(r)))


def fold_width(text: Column) -> Column:
    """Full-width letters, digits and signs, and the wide space, to their narrow forms; the native part of nfkc()."""
    return F.translate(text, _WIDE + "　", _NARROW + " ")


def search_key(text: Column) -> Column:
    """Normalised by nfkc(), lower case, without white space and ignored signs; null gives the empty string."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    return F.regexp_replace(F.lower(nfkc(text)), _CLASS, "")


def name_key(text: Column) -> Column:
    """search_key() with katakana as hiragana and variant characters folded."""
    return F.translate(search_key(text), _KATAKANA + "".join(SEARCH_VARIANTS), _HIRAGANA + "".join(SEARCH_VARIANTS.values()))


def strip_space(text: Column, variants: bool = False) -> Column:
    """Without any white space; variants: with the matching fold of characters."""
    bare = F.regexp_replace(nfkc(F.coalesce(text, F.lit(""))), r"(?U)\s", "")
    return F.translate(bare, "".join(MATCH_VARIANTS), "".join(MATCH_VARIANTS.values())) if variants else bare


def collapse_space(text: Column) -> Column:
    """Runs of white space, no-break spaces too, to one space, none at the ends."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def search_column(columns: dict[str, Column], labels: dict[str, str] | None = None, extra: list[Column] | None = None) -> Column:
    """One search key over names, labels and values of all columns, then the values in ``extra``.

    White space goes after joining, so that a query may run over two neighbouring fields.
    """
    parts: list[Column] = []
    for name, value in columns.items():
        parts += [F.lit(name), F.lit((labels or {}).get(name, name)), F.coalesce(value.cast("string"), F.lit(""))]
    parts += [F.coalesce(e.cast("string"), F.lit("")) for e in extra or []]
    return search_key(F.concat_ws(" ", *parts))


def python_key(text: str) -> str:
    """search_key() of a literal, for queries that are known when the plan is made."""
    # the four information separators are white space to Python alone
    return re.sub(r"[^\S\x1c-\x1f]|[" + re.escape(IGNORED) + "]", "", unicodedata.normalize("NFKC", text or "").lower())


def query_forms(query: str, pairs: list[tuple[str, str]]) -> list[str]:
    """The query's key and, for each pair of synonyms, the key with the first place of either replaced; no chains."""
    key = python_key(query)
    forms = [key]
    for a, b in ((python_key(a), python_key(b)) for a, b in pairs):
        forms += [key.replace(x, y, 1) for x, y in ((a, b), (b, a)) if x in key]
    return [f for f in dict.fromkeys(forms) if f]


def any_form(key: Column, forms: list[str]) -> Column:
    """Whether ``key`` holds any of the forms; no forms: true."""
    return reduce(lambda a, b: a | b, [F.contains(key, F.lit(f)) for f in forms]) if forms else F.lit(True)


def _chars(text: Column) -> Column:
    return F.filter(F.split(text, ""), lambda c: c != "")


def common_chars(a: Column, b: Column) -> Column:
    """Size of the multiset intersection of the characters of two texts."""
    # a character of a counts while b holds at least as many of it as a has had so far: sum of least counts
    return F.aggregate(
        F.array_distinct(_chars(a)),
        F.lit(0),
        lambda n, c: n + F.least(F.length(a) - F.length(F.replace(a, c)), F.length(b) - F.length(F.replace(b, c))),
    )


def name_similarity(a: Column, b: Column) -> Column:
    """0.72 edit likeness and 0.28 shared characters of two name keys; 0 where either is empty."""
    longest = F.greatest(F.length(a), F.length(b), F.lit(1))
    edit = 1 - F.levenshtein(a, b) / longest
    bag = 2 * common_chars(a, b) / (F.length(a) + F.length(b))
    return F.when((F.length(a) == 0) | (F.length(b) == 0), 0.0).otherwise(F.greatest(F.lit(0.0), edit * 0.72 + bag * 0.28))


def batch_of(path: Column, default: str = "single") -> Column:
    """What stands before the first double underscore of a file name."""
    return F.coalesce(F.nullif(F.regexp_extract(path, "^(.+?)__", 1), F.lit("")), F.lit(default))


def split_name(name: Column) -> Column:
    """Struct of the first token and the rest without spaces."""
    tokens = F.split(collapse_space(name), " ")
    return F.struct(F.get(tokens, 0).alias("family"), F.array_join(F.slice(tokens, F.lit(2), F.size(tokens)), "").alias("given"))


def clean_reading(text: Column) -> Column:
    """A recognised text: normalised, bars as spaces, white space collapsed."""
    return collapse_space(F.translate(nfkc(F.coalesce(text, F.lit(""))), "|｜", "  "))


def name_part(text: Column) -> Column:
    """What of a recognised text may stand in a name: Han, kana and Latin letters with the marks that go with them."""
    return F.regexp_replace(clean_reading(text), r"[^\p{IsHan}\p{IsHiragana}\p{IsKatakana}々ヶヵーA-Za-z]", "")


#: Signs of positions, and of positions or hands that may lead a read row (fixed values).
POSITIONS = ("投", "捕", "一", "二", "三", "遊", "外")
LEADING = (*POSITIONS, "右", "左", "両")


def name_only(text: Column) -> Column:
    """The name of a read row: without Latin letters, digits, slashes and age signs, leading position and hand signs dropped while more than two parts are left; the last two parts."""
    return let(clean_reading(text), _last_parts)


def _last_parts(clean: Column) -> Column:
    bare = collapse_space(F.regexp_replace(clean, r"[0-9A-Za-z/／歳才]", " "))

    def last(tokens: Column) -> Column:
        # how many leading signs go: up to the first other part, but two parts stay
        others = F.filter(F.transform(tokens, lambda t, i: F.when(~t.isin(*LEADING), i)), lambda i: i.isNotNull())
        first = F.coalesce(F.array_min(others), F.size(tokens))
        kept = F.slice(tokens, F.least(first, F.greatest(F.size(tokens) - 2, F.lit(0))) + 1, F.greatest(F.size(tokens), F.lit(1)))
        return let(kept, lambda k: F.array_join(F.when(F.size(k) >= 2, F.slice(k, -2, 2)).otherwise(k), " "))

    return let(F.filter(F.split(bare, " "), lambda t: t != ""), last)


def row_text(text: Column, other: Column) -> Column:
    """Struct of text, age, hand, pos, name and names read from a row's text; ``other``: a second reading of the name, preferred where it isn't empty.

    age: the first number from 18 to 24; hand: two hand signs around a slash; pos: the first of
    POSITIONS, in their order, among the first four parts. The name is what stands before the age.
    """

    def of(clean: Column) -> Column:
        age = F.regexp_extract(clean, "(18|19|20|21|22|23|24)", 1)
        hand = F.regexp_replace(F.regexp_extract(clean, r"([右左]\s*[/／]\s*[右左両])", 1), r"\s", "")
        lead = F.slice(F.split(clean, r"\s+"), 1, 4)
        pos = F.coalesce(*[F.when(F.array_contains(lead, k), k) for k in POSITIONS], F.lit(""))
        at = F.when(age != "", F.instr(clean, age)).otherwise(0)
        before = F.when(at > 1, F.substring(clean, F.lit(1), at - 1)).otherwise(clean)
        return F.struct(clean.alias("text"), age.alias("age"), F.replace(hand, F.lit("／"), F.lit("/")).alias("hand"), pos.alias("pos"), _last_parts(before).alias("by_text"))

    given = F.coalesce(other, F.lit(""))

    def named(row: Column, by_other: Column) -> Column:
        name = F.when(given != "", by_other).otherwise(row["by_text"])
        names = F.filter(F.array_distinct(F.array(name, row["by_text"], by_other)), lambda n: n != "")
        return F.struct(*[row[c].alias(c) for c in ("text", "age", "hand", "pos")], name.alias("name"), names.alias("names"))

    # every step is bound once, as its parts are used several times
    return let(let(clean_reading(text), of), lambda row: let(name_only(given), lambda by_other: named(row, by_other)))


def name_characters(text: Column) -> Column:
    """The different characters of a name that a reader has to know: Han, kana, and the marks that go with them."""
    return F.array_distinct(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"[\p{IsHan}\p{IsHiragana}\p{IsKatakana}々ヶヵー・]"), F.lit(0)))


def labelled_total(text: Column) -> Column:
    """The total behind one of its labels, common misreadings of them too, else the printed total, else 0."""
    clean = clean_reading(text)
    named = F.regexp_extract(clean, r"(?:合計|含計|会計|馬軒)[^0-9]{0,8}(\d{2,3})\s*人", 1)
    return F.coalesce(F.when(named != "", named.cast("int")), printed_total(clean), F.lit(0))


def printed_total(text: Column, low: int = 20, high: int = 200) -> Column:
    """The largest number before 人 from ``low`` to ``high``, null for none."""
    numbers = F.transform(F.regexp_extract_all(text, F.lit(r"(\d{2,3})\s*人"), F.lit(1)), lambda n: n.cast("int"))
    return F.array_max(F.filter(numbers, lambda n: (n >= low) & (n <= high)))


def is_image(path: Column) -> Column:
    return path.rlike(r"(?i)\.(png|jpe?g|webp|bmp)$")
