"""Personal data replaced by surrogates, in built-in functions only.

Entities found by pattern get replacements made from a keyed hash of their canonical
form, so the same entity has the same surrogate in every document and form of
writing. Surrogates keep type and format: digits are poured back into a number's own
punctuation, card numbers stay valid or invalid by their check digit, IBANs keep
country and valid check digits, names keep their gender, script and capitals, and
given and family names are replaced on their own, so "Mr. A B" and "Mr. B" still
agree. A given name has one gender in the whole corpus: that of most titles before
it, else of a list that has it, else either. A text that names somebody with a title
loses that name wherever it stands.

Texts are searched once: rows are written with their texts in pieces, every other
one an entity. All else works on thin rows of entities, which are joined back to the
rows that have any.

Distinctness: all words of names share one space, whatever their kind, and each other
kind has its own. Where two different entities of a space share a surrogate, or a
surrogate is itself an entity of the corpus, all but one draw again from another hash, round by
round. Entities with a large share of all mentions, of which there can only be few,
are looked up by broadcast, all others by a shuffle without a heavy key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sheaf.functions.text import let
from sheaf.llm.common import looked_up, materialise

#: Titles by the gender they tell; `n` tells none. Fixed values.
TITLES = {
    "m": ["Mr", "Mister", "Sir", "Herr", "Monsieur", "Señor", "Sr", "Signor", "г-н", "господин", "Κος", "κύριος"],
    "f": ["Mrs", "Ms", "Miss", "Madam", "Frau", "Madame", "Mme", "Mlle", "Señora", "Sra", "Srta", "Signora", "г-жа", "госпожа", "Κα", "κυρία"],
    "n": ["Dr", "Doctor", "Doktor", "Docteur", "Prof", "Professor", "Professeur", "Rev", "д-р", "Δρ"],
}
#: Given names by script and gender; what family names are built of, by script and gender (`n` where the form tells none). Fixed values.
GIVEN = {
    ("latin", "m"): [
        "Adrian", "Albert", "Anton", "Arthur", "Bruno", "Casper", "Conrad", "Daniel", "Dario", "Edgar", "Emil", "Erik", "Felix", "Fabian", "Georg", "Gustav", "Hector", "Henrik", "Hugo", "Ivo", "Jonas", "Julian", "Kilian", "Leon",
        "Lorenz", "Lukas", "Martin", "Matteo", "Nathan", "Nils", "Oliver", "Oskar", "Pablo", "Pavel", "Philip", "Rafael", "Robert", "Samuel", "Simon", "Stefan", "Theo", "Thomas", "Tobias", "Valentin", "Victor", "Walter", "Xavier", "Yannick",
    ],
    ("latin", "f"): [
        "Adele", "Agnes", "Alma", "Amelia", "Beatrice", "Bianca", "Carla", "Clara", "Daniela", "Dora", "Edith", "Elena", "Emma", "Eva", "Flora", "Frida", "Gloria", "Greta", "Hanna", "Helga", "Ida", "Irma", "Isabel", "Judith",
        "Julia", "Karla", "Laura", "Lea", "Livia", "Lucia", "Marta", "Mira", "Monica", "Nadja", "Nora", "Olivia", "Paula", "Petra", "Rebecca", "Rosa", "Sarah", "Silvia", "Sofia", "Teresa", "Ursula", "Vera", "Viola", "Zoe",
    ],
    ("cyrillic", "m"): ["Антон", "Борис", "Виктор", "Глеб", "Денис", "Егор", "Захар", "Игорь", "Кирилл", "Леонид", "Максим", "Никита", "Олег", "Павел", "Роман", "Семён"],
    ("cyrillic", "f"): ["Алина", "Белла", "Вера", "Галина", "Дарья", "Елена", "Жанна", "Зоя", "Инна", "Клара", "Лидия", "Марина", "Нина", "Ольга", "Полина", "Рита"],
    ("greek", "m"): ["Αλέξης", "Βασίλης", "Γιώργος", "Δημήτρης", "Ευγένιος", "Ζήσης", "Ηλίας", "Θωμάς", "Ιάσων", "Κώστας", "Λάμπρος", "Μάρκος", "Νίκος", "Πέτρος", "Σπύρος", "Τάσος"],
    ("greek", "f"): ["Άννα", "Βασιλική", "Γεωργία", "Δήμητρα", "Ελένη", "Ζωή", "Ηρώ", "Θάλεια", "Ιωάννα", "Κατερίνα", "Λίνα", "Μαρία", "Νίκη", "Πηνελόπη", "Σοφία", "Τίνα"],
}
STEMS = {
    "latin": ["alder", "arn", "bern", "brand", "carl", "dal", "eber", "fal", "gar", "hart", "heller", "holm", "jern", "kess", "land", "lind", "mar", "nor", "ost", "pell", "quin", "ren", "sand", "stein", "tor", "ulm", "vern", "wald", "wes", "winter", "yor", "zeller"],
    "cyrillic": ["андре", "баран", "вольн", "горшк", "добр", "ерем", "жар", "зайц", "калин", "лебед", "мороз", "назар", "орл", "павл", "соболь", "терент"],
    "greek": ["αλεξ", "βασιλ", "γεωργ", "δημητρ", "ευαγγελ", "ζαχαρ", "θεοδωρ", "ιωανν", "κωνσταντιν", "λεωνιδ", "μαρκ", "νικολ", "παναγιωτ", "σταυρ", "φωτ", "χρηστ"],
}
ENDINGS = {
    ("latin", "n"): ["berg", "by", "dale", "er", "field", "ford", "ley", "man", "mond", "more", "sen", "son", "ton", "well", "wood", "worth"],
    ("cyrillic", "m"): ["ев", "ин", "ов", "ский"],
    ("cyrillic", "f"): ["ева", "ина", "ова", "ская"],
    ("greek", "m"): ["άκης", "όπουλος", "ίδης", "άτος"],
    ("greek", "f"): ["άκη", "οπούλου", "ίδου", "άτου"],
}
#: For each class of characters, what stands for the sixteen hex digits.
ALPHABETS = {
    "[0-9]": "0123456789012345",
    "[A-Z]": "BCDFGHJKLMNPRSTV",
    r"\p{IsCyrillic}": "бвгдежзиклмнопрс",
    r"\p{IsGreek}": "βγδεζηθικλμνξπρσ",
    r"\p{IsArmenian}": "աբգդեզէըթժիլխծկհ",
    r"\p{IsGeorgian}": "აბგდევზთიკლმნოპჟ",
    r"\p{IsHebrew}": "אבגדהוזחטילמנסעפ",
    r"\p{IsArabic}": "بتثجحخدذرزسشصضطظ",
    r"\p{IsDevanagari}": "कखगघचछजझटठडढतथदध",
    r"\p{IsThai}": "กขคฆงจฉชซญดตถทธน",
    r"\p{IsHiragana}": "あいうえおかきくけこさしすせそた",
    r"\p{IsKatakana}": "アイウエオカキクケコサシスセソタ",
    r"\p{IsHangul}": "가나다라마바사아자차카타파하거너",
    r"\p{IsHan}": "天地山川水火木金土石田林竹花雨雪",
    r"\p{L}": "bcdfghjklmnprstv",
}

_START, _END = r"(?<![\p{L}\p{N}])", r"(?![\p{L}\p{N}])"
_TITLE = "|".join(sorted((t for some in TITLES.values() for t in some), key=len, reverse=True))
_WORD = r"\p{Lu}(?:['’]?[\p{L}\p{M}])+"
_NAME = f"{_WORD}(?:-{_WORD})?"
#: How many blanks may stand between a title, and a name's words.
_GAP = " {1,3}"
#: What tokens of services start with: before a dash, and without one. Fixed values.
_KEYS = "sk|pk|rk|gh[opsur]|github_pat|glpat|hf|npm|xox[abeprs]"
_PREFIXES = "AKIA|ASIA|AIza"
_TOKEN = rf"(?:(?:{_KEYS})[-_][A-Za-z0-9][A-Za-z0-9_-]{{15,}}+|(?:{_PREFIXES})[A-Za-z0-9_-]{{16,}}+)"
_HEX = "[0-9A-Fa-f]{1,4}"
_IBAN = "[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?|[a-z]{2}[0-9]{2}(?: ?[0-9]{4}){2,7}(?: ?[0-9]{1,3})?|(?=[a-z0-9]{15,34}(?![a-z0-9]))[a-z]{2}[0-9]{2}[a-z]{0,6}[0-9]{7,26}"
#: Patterns by kind, in the order in which they are tried; all start where no letter or digit stands before.
PATTERNS = {
    "email": r"(?<![._%+-])[\p{L}\p{N}_%+-]++(?:\.[\p{L}\p{N}_%+-]++)*+@(?:[\p{L}\p{N}-]{1,63}\.){1,8}\p{L}{2,24}",
    "secret": rf"(?:[0-9a-f]{{32,}}+|{_TOKEN}){_END}",
    "ip6": rf"(?=[A-Fa-f:]*+[0-9])(?:(?:{_HEX}:){{7}}{_HEX}|(?:{_HEX}:){{1,7}}(?::{_HEX}){{1,6}}|(?:{_HEX}:){{2,7}}:)(?![\p{{L}}\p{{N}}:])",
    "iban": rf"(?:{_IBAN}){_END}",
    "ip": r"(?<!\.)(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![\p{L}\p{N}]|\.[0-9])",
    "card": rf"(?:[0-9]{{13,19}}|[0-9]{{4}} [0-9]{{4}} [0-9]{{4}} [0-9]{{4}}|[0-9]{{4}}-[0-9]{{4}}-[0-9]{{4}}-[0-9]{{4}}){_END}",
    "ssn": rf"[0-9]{{3}}-[0-9]{{2}}-[0-9]{{4}}{_END}",
    "phone": rf"(?:\+[0-9]{{1,3}}[ .-]?(?:\([0-9]{{1,4}}\)[ .-]?)?[0-9]{{2,4}}(?:[ .-]?[0-9]{{2,4}}){{1,4}}|\([0-9]{{2,4}}\) ?[0-9]{{3,4}}[ .-]?[0-9]{{3,4}}|[0-9]{{3}}[.-][0-9]{{3}}[.-][0-9]{{4}}){_END}",
    "name": rf"(?:{_TITLE})\.?{_GAP}{_NAME}(?:{_GAP}{_NAME})?{_END}",
}
PATTERN = f"{_START}(?:{'|'.join(PATTERNS.values())})"
#: Every pattern implies one of these; most texts are passed over by this alone.
HINT = rf"[0-9@]|[a-f]{{32}}|(?:{_TITLE})\.?{_GAP}\p{{Lu}}|(?:{_KEYS})[-_]|(?:{_PREFIXES})"
#: A character that no text should have, around entities; texts that have it are cut in another way.
MARK = "\ufdd0"
#: Attempts before a surrogate gives up its format.
FORMATTED = 24


def _cut(text: Column, pattern: Column) -> Column:
    """A text in pieces, every second one a match of a pattern."""
    marked = F.split(F.regexp_replace(text, pattern, F.lit(f"{MARK}$0{MARK}")), MARK, -1)
    # A text that holds the mark: one search for the matches, and one for what is between.
    between, found = F.split(text, pattern, -1), F.regexp_extract_all(text, pattern, F.lit(0))
    both = F.flatten(F.zip_with(between, found, lambda a, b: F.array(F.coalesce(a, F.lit("")), F.coalesce(b, F.lit("")))))
    return F.when(F.contains(text, F.lit(MARK)), F.slice(both, F.lit(1), 2 * F.size(found) + 1)).otherwise(marked)


def pieces(text: Column) -> Column:
    """A text in pieces: what is between entities, an entity, and so on; null for null."""
    return F.when(text.rlike(HINT), _cut(text, F.lit(PATTERN))).when(text.isNotNull(), F.array(text))


def _rest(m: Column) -> Column:
    """A name without its title."""
    return F.regexp_replace(m, rf"^(?:{_TITLE})\.?{_GAP}", "")


def _is_titled(m: Column) -> Column:
    return m.rlike(rf"^(?:{_TITLE})\.?{_GAP}\p{{Lu}}")


def with_bare_names(own: Column) -> Column:
    """Pieces in which words of names that the text gives with a title are pieces of their own, wherever they stand."""

    def words(names: Column) -> Column:
        each = F.array_distinct(F.flatten(F.transform(names, lambda m: F.split(_rest(m), " +|-"))))
        return F.array_distinct(F.concat(each, F.transform(each, lambda w: F.upper(w))))

    def cut(pattern: Column) -> Column:
        return F.flatten(F.transform(own, lambda p, i: F.when(i % 2 == 0, _cut(p, pattern)).otherwise(F.array(p))))

    titled = F.filter(own, lambda p, i: (i % 2 == 1) & _is_titled(p))
    # Words of names are letters, marks and apostrophes, so they stand for themselves in a pattern.
    pattern = F.concat(F.lit(f"{_START}(?:"), F.array_join(words(titled), "|"), F.lit(f"){_END}"))
    return F.when(F.size(titled) > 0, let(pattern, cut)).otherwise(own)


def _stream(seed: Column, length: Column) -> Column:
    """Hex digits from a keyed hash: one for each character, and at least 64."""
    return F.array_join(F.transform(F.sequence(F.lit(0), F.floor(length / 60).cast("int")), lambda b: F.sha2(F.concat_ws("\u0001", seed, b.cast("string")), 256)), "")


def _chars(c: Column) -> Column:
    return F.split(c, "(?!^)(?!$)")


def _same_format(value: Column, stream: Column) -> Column:
    """Each digit and letter replaced by another of its kind and script; all else stays."""

    def one(c: Column, i: Column) -> Column:
        out = c
        for pattern, letters in reversed(ALPHABETS.items()):
            drawn = F.translate(F.substring(stream, i + 1, F.lit(1)), "0123456789abcdef", letters)
            out = F.when(c.rlike(f"^{pattern}$"), drawn).otherwise(out)
        return out

    return F.array_join(F.transform(_chars(value), one), "")


def _luhn(digits: Column) -> Column:
    """Sum whose last digit is 0 for valid numbers."""
    values = F.transform(F.reverse(_chars(digits)), lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise((c.cast("int") * 2) % 10 + F.floor(c.cast("int") / 5).cast("int")))
    return F.aggregate(values, F.lit(0), lambda a, x: a + x)


def _mod97(text: Column) -> Column:
    value = lambda c: F.when(c.rlike("[0-9]"), c.cast("int")).otherwise(F.ascii(c) - 55)
    return F.aggregate(_chars(text), F.lit(0), lambda a, c: F.pmod(a * F.when(c.rlike("[0-9]"), 10).otherwise(100) + value(c), F.lit(97)))


def _poured(surface: Column, into: str, symbols: Column) -> Column:
    """`surface` with its characters of class `into` replaced by `symbols`, one after the other."""

    def one(c: Column, i: Column) -> Column:
        before = F.length(F.regexp_replace(F.substring(surface, F.lit(1), i), f"[^{into}]", ""))
        return F.when(c.rlike(f"^[{into}]$"), F.substring(symbols, before + 1, F.lit(1))).otherwise(c)

    return F.array_join(F.transform(_chars(surface), one), "")


def kind_of(m: Column) -> Column:
    """The kind of a match, told from its form; a match without title and number is a word of a name."""
    return (
        F.when(m.contains("@"), "email")
        .when(_is_titled(m), "name")
        .when(m.rlike(r"^[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+$"), "ip")
        .when(m.rlike(rf"^[0-9a-f]{{32,}}$|^{_TOKEN}$"), "secret")
        .when(m.rlike("^[0-9A-Fa-f:]+$") & m.contains(":"), "ip6")
        .when(~m.rlike("[0-9]"), "name")
        .when(m.rlike(r"^[A-Za-z]{2}[0-9]{2}[A-Za-z0-9 ]+$"), "iban")
        .when(m.rlike(r"^[0-9]{3}-[0-9]{2}-[0-9]{4}$"), "ssn")
        .when(m.rlike(r"^[0-9]{13,}$|^(?:[0-9]{4}[ -]){3}[0-9]{4}$"), "card")
        .otherwise("phone")
    )


def _script(word: Column) -> Column:
    return F.when(word.rlike(r"\p{IsCyrillic}"), "cyrillic").when(word.rlike(r"\p{IsGreek}"), "greek").when(word.rlike(r"^[\p{IsLatin}'’]"), "latin").otherwise("other")


def _any(words: list[str]) -> str:
    return "|".join(sorted(words, key=len, reverse=True))


def _title_gender(m: Column) -> Column:
    return F.when(m.rlike(rf"^(?:{_any(TITLES['f'])})\.? "), "f").when(m.rlike(rf"^(?:{_any(TITLES['m'])})\.? "), "m").otherwise("")


def _settled(male: Column, female: Column, given: Column) -> Column:
    """The gender of a given name in a corpus: that of more of the titles before it, else of a list that has it, else `n`."""
    listed = {g: F.array(*(F.lit(x) for (_, of), names in GIVEN.items() if of == g for x in names)) for g in "fm"}
    told = F.when(F.array_contains(listed["f"], given), "f").when(F.array_contains(listed["m"], given), "m").otherwise("n")
    return F.when(female > male, "f").when(male > female, "m").otherwise(told)


def _family_gender(family: Column) -> Column:
    """The gender that the form of a family name tells, in scripts where it does."""
    low = F.lower(family)
    female = F.when(low.rlike(r"\p{IsCyrillic}"), low.rlike("(?:ова|ева|ёва|ина|ына|ая)$")).otherwise(low.rlike("(?:ου|η|α|ή|ά)$"))
    return F.when(_script(family).isin("latin", "other"), "n").when(female, "f").otherwise("m")


def _unit(kind: Column, value: Column, said: Column | None = None) -> Column:
    return F.struct(kind.alias("kind"), value.alias("value"), (F.lit("") if said is None else said).alias("said"))


def _plain_name(word: Column) -> Column:
    """A word of a name however it is capitalised."""
    return F.initcap(F.lower(word))


def units(m: Column) -> Column:
    """What of a match is replaced as a unit: array of (kind, value, said), in canonical form; `said` is the gender that a title tells of a given name.

    A name with a title has its family name, before that maybe its given name, each
    in one or two parts; anything else is one.
    """

    def named(parts: Column) -> Column:
        given = F.when(F.size(parts) > 1, F.transform(F.split(parts[0], "-"), _plain_name)).otherwise(F.array().cast("array<string>"))
        family = F.split(F.element_at(parts, -1), "-")
        first = F.transform(given, lambda w: _unit(F.concat_ws("_", F.lit("given"), _script(w)), w, _title_gender(m)))
        return F.concat(first, F.transform(family, lambda w: _unit(F.concat_ws("_", F.lit("family"), _family_gender(w), _script(w)), _plain_name(w))))

    kind = kind_of(m)
    value = F.when(kind == "email", F.lower(m)).when(kind.isin("card", "ssn", "phone"), F.regexp_replace(m, "[^0-9]", "")).when(kind == "iban", F.upper(F.replace(m, F.lit(" "), F.lit("")))).when(kind == "ip6", F.lower(m)).otherwise(m)
    return F.when(kind == "name", named(F.split(_rest(m), " +"))).otherwise(F.array(_unit(kind, value)))


def entities(own: Column) -> Column:
    """Of pieces, their entities in order: array of (m, units). A bare word of a name is the unit that the name with a title has."""
    found = F.filter(own, lambda p, i: i % 2 == 1)

    def read(known: Column) -> Column:
        def bare(m: Column) -> Column:
            same = F.filter(known, lambda u: u["value"] == _plain_name(m))
            # Capitals that are not told back to the word they come from are a family name of their own.
            return F.when(F.size(same) > 0, F.slice(same, 1, 1)).otherwise(F.array(_unit(F.concat_ws("_", F.lit("family"), _family_gender(m), _script(m)), _plain_name(m))))

        return F.transform(found, lambda m: F.struct(m.alias("m"), F.when((kind_of(m) == "name") & ~_is_titled(m), bare(m)).otherwise(units(m)).alias("units")))

    return let(F.array_distinct(F.flatten(F.transform(F.filter(found, _is_titled), units))), read)


def _drawn(units: DataFrame, attempt: int, key: str) -> DataFrame:
    """Units (`kind`, `value`, `gender`, ...) with their replacement at an attempt, `new`; later attempts draw anew, names also get longer."""
    kind, value, stream = F.col("kind"), F.col("value"), F.col("__stream")
    out = units.withColumn("__stream", _stream(F.concat_ws("\u0001", F.lit(key), kind, value, F.lit(str(attempt))), F.length(value)))
    if attempt >= FORMATTED:
        return out.withColumn("new", F.concat(kind, F.lit("-"), F.substring(stream, 1, 24))).drop("__stream")
    out = out.withColumn("__same", _same_format(value, stream))
    same = F.col("__same")
    byte = lambda i: F.conv(F.substring(stream, F.lit(2 * i + 1), F.lit(2)), 16, 10).cast("int")
    if attempt < 4:
        ip = F.concat_ws(".", F.lit("10"), *(byte(i).cast("string") for i in range(3)))
    else:
        ip = F.concat_ws(".", (F.pmod(byte(3), F.lit(223)) + 1).cast("string"), *(byte(i).cast("string") for i in range(3)))
    host = F.translate(F.substring(F.reverse(stream), F.lit(1), F.lit(10)), "0123456789", "ghijklmnop")
    email = F.concat(F.substring_index(same, "@", 1), F.lit("@"), host, F.lit(".example."), F.substring_index(value, ".", -1))
    # Numbers keep their first digit, which may tell country or issuer.
    number = F.concat(F.substring(value, F.lit(1), F.lit(1)), F.substring(same, F.lit(2), F.length(value))) if attempt < 8 else same
    short = F.substring(number, F.lit(1), F.length(value) - 1)
    check = F.pmod(10 - F.pmod(_luhn(F.concat(short, F.lit("0"))), F.lit(10)), F.lit(10)).cast("string")
    card = F.when(F.pmod(_luhn(value), F.lit(10)) == 0, F.concat(short, check)).otherwise(number)
    country, bban = F.substring(value, F.lit(1), F.lit(2)), F.substring(same, F.lit(5), F.length(value))
    iban = F.concat(country, F.lpad((98 - _mod97(F.concat(bban, country, F.lit("00")))).cast("string"), 2, "0"), bban)
    secret = F.when(value.rlike("^[0-9a-f]+$"), F.substring(stream, F.lit(1), F.length(value))).otherwise(F.concat(F.substring(value, F.lit(1), F.lit(4)), F.substring(same, F.lit(5), F.length(value))))
    new = F.when(kind == "email", email).when(kind == "ip", ip).when(kind == "card", card).when(kind == "iban", iban).when(kind == "ip6", _poured(value, "0-9a-f", stream)).when(kind == "secret", secret).when(kind == "ssn", F.concat(F.lit("9"), F.substring(same, F.lit(2), F.lit(9))))
    # Names: drawn from lists, and the longer the more often they had to be drawn.
    pick = lambda some, i: F.get(F.array(*(F.lit(x) for x in some)), F.pmod(byte(i) * 256 + byte(i + 1), F.lit(len(some))))
    script, form = F.substring_index(kind, "_", -1), F.substring(F.substring_index(kind, "_", 2), -1, 1)
    family, given = F.lit(None).cast("string"), F.lit(None).cast("string")
    for (name, g), endings in ENDINGS.items():
        stems = F.concat(*(pick(STEMS[name], 2 * i) for i in range(1 + min(attempt, 6))))
        family = F.when((script == name) & (form == g), F.initcap(F.concat(stems, pick(endings, 14)))).otherwise(family)
    for (name, g), names in GIVEN.items():
        fits = (script == name) & ((F.col("gender") == g) | ((F.col("gender") == "n") & (F.pmod(byte(30), F.lit(2)) == (0 if g == "m" else 1))))
        # Without a dash: two names with one are two surrogates.
        given = F.when(fits, F.initcap(F.lower(F.concat(*(pick(names, 16 + 2 * i) for i in range(1 + min(attempt, 6))))))).otherwise(given)
    other = F.initcap(F.concat(same, F.substring(_same_format(value, F.reverse(stream)), 1, attempt)))
    new = new.when(kind.startswith("family"), F.coalesce(family, other)).when(kind.startswith("given"), F.coalesce(given, other))
    return out.withColumn("new", new.otherwise(number)).drop("__stream", "__same")


def _worn(m: Column, kind: Column, new: Column) -> Column:
    """The surrogate in the writing of the match."""
    formatted = ~F.startswith(new, F.concat(kind, F.lit("-")))
    return F.when(kind.isin("card", "ssn", "phone") & formatted, _poured(m, "0-9", new)).when((kind == "iban") & formatted, F.when(m == F.lower(m), _poured(m, "a-z0-9", F.lower(new))).otherwise(_poured(m, "A-Z0-9", new))).otherwise(new)


def _worn_name(m: Column, new: Column) -> Column:
    """A name's title, and its words' surrogates with what stood between them and in their capitals."""
    words = F.split(_rest(m), " +|-")
    capitals = F.zip_with(words, new, lambda w, x: F.when((F.length(w) > 2) & (w == F.upper(w)), F.upper(x)).otherwise(x))
    between = F.regexp_extract_all(_rest(m), F.lit(" +|-"), F.lit(0))
    whole = F.zip_with(capitals, between, lambda w, x: F.concat(w, F.coalesce(x, F.lit(""))))
    return F.concat(F.regexp_extract(m, rf"^(?:{_TITLE})\.?{_GAP}", 0), F.array_join(whole, ""))


def held(docs: DataFrame, text: str = "text") -> DataFrame:
    """`docs` written with `__p_row` (a number of its own for each row), `__p_own` (pieces of the text), `__p_found` (its entities) and `__p_has`, by which they are kept apart."""
    found = lambda own: F.struct(own.alias("own"), F.when(F.size(own) > 1, entities(own)).alias("found"))
    cut = let(pieces(F.col(text)), lambda own: let(with_bare_names(own), found))
    own = docs.withColumn("__p_cut", cut).drop(text).select("*", F.col("__p_cut.own").alias("__p_own"), F.col("__p_cut.found").alias("__p_found")).drop("__p_cut")
    own = own.withColumns({"__p_row": F.monotonically_increasing_id(), "__p_has": F.coalesce(F.size("__p_own") > 1, F.lit(False))})
    return materialise(own, "held", by=["__p_has"])


def _space(kind: Column) -> Column:
    """In what a surrogate has to be distinct: all words of names are written alike."""
    return F.when(kind.startswith("given") | kind.startswith("family"), "name").otherwise(kind)


def surrogates(found: DataFrame, key: str) -> DataFrame:
    """From units (`kind`, `value`, `said`) in any number: all different ones with their mentions and surrogates, `kind`, `value`, `n`, `new`; no two of a space share one, and none is itself a unit.

    Units are compared by shuffles of their surrogates, round by round until each has
    its own; a round gives it, of those with equal surrogates, to the smallest value.
    What finds none in its format, as where a corpus holds most numbers of a length,
    gets one without format in the end.
    """
    votes = [F.count_if(F.col("said") == g).alias(g) for g in "mf"]
    own = found.groupBy("kind", "value").agg(F.count("*").alias("n"), *votes)
    gender = F.when(F.col("kind").startswith("given"), _settled(F.col("m"), F.col("f"), F.col("value"))).otherwise("")
    todo = materialise(own.select("kind", "value", "n", gender.alias("gender"), _space(F.col("kind")).alias("space")), "units")
    taken, attempt, out = todo.select("space", F.col("value").alias("new")), 0, None
    while out is None or not todo.isEmpty():
        # A space's surrogates: small rows with map-side minima.
        drawn = materialise(_drawn(todo, attempt, key), "drawn")
        first = drawn.groupBy("space", "new").agg(F.min_by(F.struct("kind", "value", "n"), F.struct("value", "kind")).alias("u")).join(taken, ["space", "new"], "left_anti").select("space", "u.*", "new")
        first = materialise(first, "surrogates")
        todo = materialise(todo.join(first, ["kind", "value"], "left_anti"), "again")
        out = first if out is None else out.unionByName(first)
        taken, attempt = taken.unionByName(first.select("space", "new")), attempt + 1
    return out.select("kind", "value", "n", "new")


def pseudonymise(docs: DataFrame, key: str, text: str = "text", counted: str | None = None) -> DataFrame:
    """`docs` with the entities of its texts replaced; same rows and columns, and with `counted` their number.

    `key` is the secret that the surrogates hang on; the same key gives the same ones
    for the same corpus. Null texts stay null, empty ones empty. Repeated rows come
    out alike. A column named like `counted` gives way to it. Only rows with entities
    take part in a join, each with the replacements of its own entities.
    """
    columns = [c for c in docs.columns if c != counted]
    rows = held(docs.select(*columns), text)
    having = rows.where("__p_has")
    each = having.select("__p_row", F.posexplode("__p_found").alias("i", "e")).select("__p_row", "i", "e.m", F.posexplode("e.units").alias("j", "u")).select("__p_row", "i", "m", "j", "u.kind", "u.value")
    known = surrogates(having.select(F.explode(F.flatten(F.transform("__p_found", lambda e: e["units"]))).alias("u")).select("u.*"), key)
    new = looked_up(each, known, ["kind", "value"]).repartition("__p_row")
    whole = new.groupBy("__p_row", "i").agg(F.first("m").alias("m"), F.array_sort(F.collect_list(F.struct("j", "kind", "new"))).alias("n"))
    n = F.col("n")
    worn = F.when(F.startswith(n[0]["kind"], F.lit("given")) | F.startswith(n[0]["kind"], F.lit("family")), _worn_name(F.col("m"), F.transform(n, lambda x: x["new"]))).otherwise(_worn(F.col("m"), n[0]["kind"], n[0]["new"]))
    made = whole.select("__p_row", F.struct("i", worn.alias("w")).alias("w")).groupBy("__p_row").agg(F.array_sort(F.collect_list("w")).alias("__p_new"))
    plain = F.filter("__p_own", lambda p, i: i % 2 == 0)
    rebuilt = F.array_join(F.zip_with(plain, "__p_new", lambda p, w: F.concat(p, F.coalesce(w["w"], F.lit("")))), "")
    out = having.join(made, "__p_row").withColumns({text: rebuilt, "__p_n": F.size("__p_found").cast("long")})
    rest = rows.where("not __p_has").withColumns({text: F.get("__p_own", F.lit(0)), "__p_n": F.lit(0).cast("long")})
    count = [F.col("__p_n").alias(counted)] if counted is not None else []
    return out.select(*columns, *count).unionByName(rest.select(*columns, *count))
