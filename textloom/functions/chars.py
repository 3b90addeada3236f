"""Characters as SQL expressions that Spark and DuckDB both understand: each function returns text for F.expr() or a query.

`point` is an expression of a code point: ascii(c) in Spark, unicode(c) in DuckDB. Tables follow the Unicode code charts. Positions and lengths count code points.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Ranges = tuple[tuple[int, int], ...]


def _spread(chars: str) -> Ranges:
    return tuple((ord(c), ord(c)) for c in chars)


#: Tag of a character by itself, in order of precedence.
SPACES: Ranges = ((0x09, 0x0D), (0x20, 0x20), (0xA0, 0xA0), (0x1680, 0x1680), (0x2000, 0x200F), (0x202F, 0x202F), (0x205F, 0x205F), (0x2028, 0x2029), (0x3000, 0x3000), (0x85, 0x85), (0xFEFF, 0xFEFF))
SYLLABLES: Ranges = ((0xAC00, 0xD7A3),)
ONSETS: Ranges = ((0x1100, 0x115E), (0xA960, 0xA97C))
VOWELS: Ranges = ((0x1160, 0x11A7), (0xD7B0, 0xD7C6))
CODAS: Ranges = ((0x11A8, 0x11FF), (0xD7CB, 0xD7FB))
TONES: Ranges = ((0x302E, 0x302F),)
HANZI: Ranges = ((0x2E80, 0x2FD5), (0x3005, 0x3007), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x323AF))
TAGS: tuple[tuple[str, Ranges], ...] = (
    ("SPACE", SPACES),
    ("SN", ((0x30, 0x39),)),
    ("SL", ((0x41, 0x5A), (0x61, 0x7A))),
    ("HANGUL", SYLLABLES + ONSETS + VOWELS + CODAS + TONES),
    ("SF", _spread(".!?⁇⁈⁉。！．？｡")),
    ("SO", _spread("-~∼〜～")),
    ("SE", _spread("…⁝")),
    ("SP", _spread(",;:/·、，：；､")),
    ("SSO", _spread("(<[{‘“≪〈《「『【〔〖〘〚（＜［｛｟｢")),
    ("SSC", _spread(")>]}’”≫〉》」』】〕〗〙〛）＞］｝｠｣")),
    ("SS", _spread("\"'­―─－")),
    ("SH", HANZI),
)
#: Both sides of brackets and quotes, by kind from 1 on.
PAIRS = ("''", '""', "()", "<>", "[]", "{}", "‘’", "“”", "≪≫", "〈〉", "《》", "「」", "『』", "【】", "〔〕", "〖〗", "〘〙", "〚〛", "（）", "＜＞", "［］", "｛｝", "｟｠", "｢｣")
#: Scripts by their Unicode blocks; what is in none is "common".
SCRIPTS: tuple[tuple[str, Ranges], ...] = (
    ("latin", ((0x41, 0x5A), (0x61, 0x7A), (0xAA, 0xAA), (0xBA, 0xBA), (0xC0, 0xD6), (0xD8, 0xF6), (0xF8, 0x24F), (0x1E00, 0x1EFF), (0x2C60, 0x2C7F), (0xA720, 0xA7FF), (0xAB30, 0xAB64), (0xFF21, 0xFF3A), (0xFF41, 0xFF5A))),
    ("ipa", ((0x250, 0x2AF),)),
    ("greek", ((0x370, 0x3FF), (0x1F00, 0x1FFF))),
    ("cyrillic", ((0x400, 0x52F), (0x1C80, 0x1C8F), (0x2DE0, 0x2DFF), (0xA640, 0xA69F))),
    ("armenian", ((0x530, 0x58F),)),
    ("hebrew", ((0x590, 0x5FF), (0xFB1D, 0xFB4F))),
    ("arabic", ((0x600, 0x6FF), (0x750, 0x77F), (0x8A0, 0x8FF), (0xFB50, 0xFDFF), (0xFE70, 0xFEFE))),
    ("syriac", ((0x700, 0x74F),)),
    ("thaana", ((0x780, 0x7BF),)),
    ("devanagari", ((0x900, 0x97F), (0xA8E0, 0xA8FF))),
    ("bengali", ((0x980, 0x9FF),)),
    ("gurmukhi", ((0xA00, 0xA7F),)),
    ("gujarati", ((0xA80, 0xAFF),)),
    ("tamil", ((0xB80, 0xBFF),)),
    ("telugu", ((0xC00, 0xC7F),)),
    ("kannada", ((0xC80, 0xCFF),)),
    ("malayalam", ((0xD00, 0xD7F),)),
    ("sinhala", ((0xD80, 0xDFF),)),
    ("thai", ((0xE00, 0xE7F),)),
    ("lao", ((0xE80, 0xEFF),)),
    ("tibetan", ((0xF00, 0xFFF),)),
    ("myanmar", ((0x1000, 0x109F), (0xA9E0, 0xA9FF), (0xAA60, 0xAA7F))),
    ("georgian", ((0x10A0, 0x10FF), (0x1C90, 0x1CBF), (0x2D00, 0x2D2F))),
    ("ethiopic", ((0x1200, 0x139F), (0x2D80, 0x2DDF))),
    ("cherokee", ((0x13A0, 0x13FF), (0xAB70, 0xABBF))),
    ("khmer", ((0x1780, 0x17FF), (0x19E0, 0x19FF))),
    ("mongolian", ((0x1800, 0x18AF),)),
    ("hiragana", ((0x3041, 0x309F),)),
    ("katakana", ((0x30A0, 0x30FF), (0x31F0, 0x31FF), (0xFF66, 0xFF9D))),
    ("bopomofo", ((0x3100, 0x312F), (0x31A0, 0x31BF))),
    ("hangul", ((0x1100, 0x11FF), (0x3131, 0x318E), (0xA960, 0xA97F), (0xAC00, 0xD7A3), (0xD7B0, 0xD7FF))),
    ("hanja", HANZI),
    ("punctuation", ((0x2010, 0x2027), (0x2030, 0x205E), (0x3001, 0x3003), (0x3008, 0x3020))),
    ("currency", ((0x20A0, 0x20CF),)),
    ("arrows", ((0x2190, 0x21FF),)),
    ("mathematical", ((0x2200, 0x22FF),)),
    ("box_drawing", ((0x2500, 0x257F),)),
    ("geometric", ((0x25A0, 0x25FF),)),
    ("emoji", ((0x2600, 0x27BF), (0x1F300, 0x1F6FF), (0x1F900, 0x1FAFF))),
)
#: Conjoining initial and final consonants and what stands alone for them.
INITIALS = "ㄱㄲㄴㄷㄸㄹㅁㅂㅃㅅㅆㅇㅈㅉㅊㅋㅌㅍㅎ"
FINALS = "ㄱㄲㄳㄴㄵㄶㄷㄹㄺㄻㄼㄽㄾㄿㅀㅁㅂㅄㅅㅆㅇㅈㅊㅋㅌㅍㅎ"
#: Of a double final consonant the part that stays and the one that moves.
DOUBLE = {"ㄳ": "ㄱㅅ", "ㄵ": "ㄴㅈ", "ㄶ": "ㄴㅎ", "ㄺ": "ㄹㄱ", "ㄻ": "ㄹㅁ", "ㄼ": "ㄹㅂ", "ㄽ": "ㄹㅅ", "ㄾ": "ㄹㅌ", "ㄿ": "ㄹㅍ", "ㅀ": "ㄹㅎ", "ㅄ": "ㅂㅅ"}
MORPH_TAGS = ("NNG NNP NNB NR NP VV VA VX VCP VCN MM MAG MAJ IC JKS JKC JKG JKO JKB JKV JKQ JX JC EP EF EC ETN ETM XPN XSN XSV XSA XSM XR SF SP SS SSO SSC SE SO SW SL SH SN SB UN W_URL W_EMAIL W_HASHTAG W_MENTION W_SERIAL W_EMOJI Z_CODA Z_SIOT USER0 USER1 USER2 USER3 USER4").split()
IRREGULAR = ("VV", "VA", "VX", "XSA")
DIALECTS = {"standard": 0, **{name: 1 << k for k, name in enumerate("gyeonggi chungcheong gangwon gyeongsang jeolla jeju hwanghae hamgyeong pyeongan archaic".split())}}


def within(point: str, ranges: Ranges) -> str:
    return "(" + " OR ".join(f"{point} = {a}" if a == b else f"{point} BETWEEN {a} AND {b}" for a, b in ranges) + ")"


def case(point: str, table: tuple[tuple[str, Ranges], ...], other: str) -> str:
    return "CASE " + " ".join(f"WHEN {within(point, r)} THEN '{name}'" for name, r in table) + f" ELSE '{other}' END"


def char_tag(point: str) -> str:
    """Tag of a character: SPACE, HANGUL, or that of its class; SW for all others."""
    return case(point, TAGS, "SW")


def script(point: str) -> str:
    return case(point, SCRIPTS, "common")


def pair_kind(point: str) -> str:
    """1 to 24 for brackets and quotes, the same on both sides; 0 otherwise."""
    return "CASE " + " ".join(f"WHEN {within(point, _spread(''.join(dict.fromkeys(p))))} THEN {k}" for k, p in enumerate(PAIRS, 1)) + " ELSE 0 END"


def bullet_kind(form: str, first: str, second: str) -> str:
    """Kind of a list mark. form: its text; first, second: code points of its first two characters. `x.` 1, `(x)` 2, `x)` 3, and 4 times the group of x; circled and framed numbers have kinds of their own."""
    framed = f"(right({form}, 1) = ')' AND left({form}, 1) = '(')"
    x = f"(CASE WHEN {framed} THEN {second} ELSE {first} END)"
    alone = " ".join(f"WHEN {within(x, r)} THEN {k}" for k, r in ((24, ((0x2460, 0x2473), (0x2780, 0x2789))), (25, ((0x2776, 0x277F), (0x278A, 0x2793))), (26, ((0x2474, 0x2487),)), (27, ((0x2488, 0x249B),))))
    group = " ".join(f"WHEN {within(x, r)} THEN {4 * k}" for k, r in ((1, SYLLABLES), (2, ((0x3131, 0x314E),)), (3, ((0x30, 0x39),)), (4, ((0x2160, 0x216B),)), (5, ((0x2170, 0x217B),))))
    shape = f"CASE WHEN right({form}, 1) = '.' THEN 1 WHEN {framed} THEN 2 WHEN right({form}, 1) = ')' THEN 3 ELSE 0 END"
    return f"CASE {alone} ELSE (CASE {group} ELSE 0 END) + ({shape}) END"


def standing(text: str) -> str:
    """Conjoining initial and final consonants as letters of their own."""
    out = text
    chars = "".join(map(chr, range(0x1100, 0x1113))) + "".join(map(chr, range(0x11A8, 0x11C3)))
    return f"translate({out}, '{chars}', '{INITIALS + FINALS}')"


def without_space(text: str) -> str:
    return f"replace({text}, ' ', '')"


def vowel_of(point: str) -> str:
    """0 to 20: the vowel of a syllable; -1 otherwise."""
    return f"CASE WHEN {point} BETWEEN 44032 AND 55203 THEN CAST(floor((({point} - 44032) % 588) / 28) AS INT) ELSE -1 END"


def coda_of(point: str) -> str:
    """1 to 27: the final consonant of a syllable, or of a conjoining one by itself; 0 without; -1 for other characters."""
    return f"CASE WHEN {point} BETWEEN 44032 AND 55203 THEN ({point} - 44032) % 28 WHEN {point} BETWEEN 4520 AND 4546 THEN {point} - 4519 ELSE -1 END"


#: Conditions on the end of the form before: what coda (as coda_of) satisfies them. Other characters satisfy all but applosive.
CONDITIONS = {"any": "true", "vowel": "{c} <= 0", "vocalic": "{c} <= 0 OR {c} = 8", "vocalic_h": "{c} <= 0 OR {c} = 8 OR {c} = 27", "non_vowel": "{c} <> 0", "non_vocalic": "NOT ({c} = 0 OR {c} = 8)", "non_vocalic_h": "NOT ({c} = 0 OR {c} = 8 OR {c} = 27)", "applosive": "{c} IN (1, 2, 3, 7, 17, 18, 19, 20, 22, 23, 24, 25)"}


def meets(condition: str, coda: str) -> str:
    return "(" + CONDITIONS[condition].format(c=f"({coda})") + ")"


def positive(vowels: str) -> str:
    """Whether an ending in 아 follows: vowels is an expression of the numbers (vowel_of) of the last vowel that isn't ㅡ."""
    return f"({vowels} IN (0, 2, 8, 12))"


def tag_name(tag: str, regular: str) -> str:
    """A tag's name with -I for irregular stems."""
    stems = ", ".join(f"'{t}'" for t in IRREGULAR)
    return f"CASE WHEN {tag} IN ({stems}) AND NOT {regular} THEN concat({tag}, '-I') ELSE {tag} END"


def parsed_tag(name: str) -> str:
    """The tag of a name, without -I and -R; UNKNOWN if there is none."""
    known = ", ".join(f"'{t}'" for t in MORPH_TAGS)
    bare = f"regexp_replace({name}, '^(VV|VA|VX|XSA)-[IR]$', '{{group}}1')"
    return f"CASE WHEN {bare} IN ({known}) THEN {bare} ELSE 'UNKNOWN' END"


def dialect_mask(names: str, contains: str) -> str:
    """Bit mask of a comma-separated list; contains: a template of two expressions, whether a list has a name."""
    return " + ".join(f"(CASE WHEN {contains.format(names, chr(39) + n + chr(39))} THEN {bit} ELSE 0 END)" for n, bit in DIALECTS.items() if bit)


def dialect_allowed(dialect: str, mask: str) -> str:
    return f"({dialect} = 0 OR ({dialect} & {mask}) <> 0)"


def byte_offset(text: str, place: str, duckdb: bool = False) -> str:
    """The UTF-8 offset of a place in code points."""
    return f"strlen(left({text}, {place}))" if duckdb else f"octet_length(left({text}, {place}))"


def utf16_offset(text: str, place: str, duckdb: bool = False) -> str:
    """The UTF-16 offset of a place in code points: characters beyond the basic plane count twice."""
    if duckdb:
        return f"({place} + len(regexp_extract_all(left({text}, {place}), '[\\x{{10000}}-\\x{{10FFFF}}]')))"
    return f"CAST(octet_length(encode(left({text}, {place}), 'UTF-16BE')) / 2 AS BIGINT)"


# --- the same for Columns, where state runs along a text


def points(text: Column) -> Column:
    return F.transform(F.split(text, ""), lambda c: F.ascii(c))


def from_point(code: Column) -> Column:
    """The character of a code point of the basic plane."""
    return F.decode(F.unhex(F.lpad(F.hex(code), 4, "0")), "UTF-16BE")


def _at(chars: Column, i: Column) -> Column:
    """The character at place i (from 0), an empty one beyond either end."""
    return F.coalesce(F.get(chars, i), F.lit(""))


def join_hangul(text: Column) -> Column:
    """Open syllables and the conjoining final consonants behind them put together again, conjoining onsets and vowels too. Each character depends on its neighbours only."""
    chars = F.split(text, "")
    is_open = lambda p: p.between(0xAC00, 0xD7A3) & ((p - 0xAC00) % 28 == 0)
    onset, vowel, coda = (lambda p: p.between(0x1100, 0x1112)), (lambda p: p.between(0x1161, 0x1175)), (lambda p: p.between(0x11A8, 0x11C2))

    def one(c: Column, i: Column) -> Column:
        before2, before, here, after, after2 = (F.ascii(_at(chars, i + k)) for k in (-2, -1, 0, 1, 2))
        pair = onset(here) & vowel(after)
        syllable = (here - 0x1100) * 588 + (after - 0x1161) * 28 + 0xAC00
        return (
            F.when(pair, from_point(F.when(coda(after2), syllable + after2 - 0x11A7).otherwise(syllable)))
            .when(vowel(here) & onset(before), F.lit(""))
            .when(is_open(here) & coda(after), from_point(here + after - 0x11A7))
            .when(coda(here) & (is_open(before) | (vowel(before) & onset(before2))), F.lit(""))
            .otherwise(c)
        )

    return F.array_join(F.transform(chars, one), "")


def normalize_coda(text: Column) -> Column:
    """A syllable's final consonant that the same letter follows by itself goes to that letter: 키윜ㅋㅋ becomes 키위ㅋㅋㅋ. Of a double one the second part goes, if that is the letter."""
    simple = {i + 1: c for i, c in enumerate(FINALS) if c not in DOUBLE}
    double = {i + 1: DOUBLE[c] for i, c in enumerate(FINALS) if c in DOUBLE}
    moved = F.create_map(*[x for k, c in {**simple, **{k: d[1] for k, d in double.items()}}.items() for x in (F.lit(k), F.lit(c))])
    stays = F.create_map(*[x for k, d in double.items() for x in (F.lit(k), F.lit(FINALS.index(d[0]) + 1))])
    chars = F.split(text, "")

    def one(c: Column, i: Column) -> Column:
        here, after = F.ascii(c), _at(chars, i + 1)
        coda = F.when(here.between(0xAC00, 0xD7A3), (here - 0xAC00) % 28).otherwise(F.lit(0))
        return F.when(F.element_at(moved, coda) == after, F.concat(from_point(here - coda + F.coalesce(F.element_at(stays, coda), F.lit(0))), after)).otherwise(c)

    return F.array_join(F.transform(chars, one), "")


def repeated(text: Column) -> Column:
    """Whether a text of 5 characters or more is three or more times the same part."""
    return (F.length(text) >= 5) & F.rlike(text, F.lit(r"(?s)^(.+?)\1\1+$"))


def split_escaped(text: Column, delimiter: str) -> Column:
    """Parts between delimiters; a doubled one is the character itself."""
    mark = "\ue000"
    return F.transform(F.split(F.replace(text, F.lit(delimiter * 2), F.lit(mark)), "[" + delimiter.replace("\\", "\\\\") + "]"), lambda p: F.replace(p, F.lit(mark), F.lit(delimiter)))
