"""Surrogates for personal data, with DataFrame functions only.

Entities are found by one pattern; each is reduced to a canonical form (digits of a number, lower case of an address), and the
surrogate is a keyed function of that form, so an entity has the same surrogate wherever it occurs and however it is written.
Rendering puts it into the format of each occurrence: separators, case, a valid check digit where the original had one.

Numbers (network addresses, identity, card, account and phone numbers) go through keyed permutations of the numbers of their
kind, length and range (Feistel rounds, walked on where a result would leave the range), so surrogates are distinct by
construction however many there are; one may equal another original. Mail addresses and names get hashed surrogates. All
distinct ones of the corpus are checked as they are written: a surrogate must not be another entity's and not be an entity
itself. Those that clash try again with the next attempt number, round by round; only they, and names whose titles differ between
documents, are joined back to documents, on (doc_id, hash of the text). Everything else is computed within a row, so hot entities and sources don't gather anywhere.

Persons are found by a title before up to three capitalised words. Each of these words is replaced by a surrogate of its own
wherever it stands capitalised in that document, titled or not, so full names, given and last names go on naming one person,
whatever the title; the ending of a given name tells the gender that titles give it anywhere in the corpus (that of neither
where they differ), so it is the same in all documents. Not found: persons whom no title names in the
document, names in scripts without capitals, street addresses, other numbers.
"""

from __future__ import annotations

import secrets

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cellspan.llm.common import stage, table

#: Session setting with the secret key of the surrogates.
KEY_SETTING = "spark.cellspan.pii.key"
ATTEMPTS = 64
SALTS = 16
ROUNDS = 8

_NEUTRAL, _WOMEN, _MEN = r"(?:Dr|Prof)\.", r"(?:Mrs|Ms|Sra|Mme)\.|Miss|Frau|Señora|Madame|Госпожа|Κυρία", r"(?:Mr|Sr)\.|Mister|Herr|Señor|Monsieur|Господин|Κύριος"
_NAME = r"\p{Lu}\p{L}+"
PERSON = rf"(?<!\p{{L}})(?:{_NEUTRAL}|{_WOMEN}|{_MEN})(?: {_NAME}){{1,3}}"
_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
EMAIL = r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)*(?<=\.[A-Za-z]{2,18})"
IPV4 = rf"(?<![0-9.])(?:{_OCTET}\.){{3}}{_OCTET}(?![0-9]|\.[0-9])"
SSN = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9]|-[0-9])"
IBAN = r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"
CARD = r"(?<![0-9])(?:[0-9]{4}[ -]?){3}[0-9]{4}(?![0-9])|(?<![0-9])[0-9]{13,19}(?![0-9])"
PHONE = r"\+[0-9]{1,3}[ .-]?\(?[0-9]{1,4}\)?(?:[ .-]?[0-9]{2,4}){2,4}(?![0-9])|(?<![0-9])\([0-9]{3}\) ?[0-9]{3}[ .-][0-9]{4}(?![0-9])|(?<![0-9])[0-9]{3}[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9])"
KINDS = {"email": EMAIL, "ipv4": IPV4, "ssn": SSN, "iban": IBAN, "card": CARD, "phone": PHONE}
PATTERN = "|".join(KINDS.values())

#: Syllables of invented names by script, and endings of given names by gender: f, m, and n where no title tells.
SYLLABLES = {"latin": "ba be bi bo da de di do fa fe ga go ka ke ki ko la le li lo ma me mi mo na ne ni no ra re ri ro", "cyrillic": "ба бе би бо да де ди до фа фе га го ка ке ки ко ла ле ли ло ма ме ми мо на не ни но ра ре ри ро", "greek": "βα βε βι βο δα δε δι δο φα φε γα γο κα κε κι κο λα λε λι λο μα με μι μο να νε νι νο ρα ρε ρι ρο"}
ENDINGS = {"latin": {"f": "na", "m": "nd", "n": "nt"}, "cyrillic": {"f": "на", "m": "ов", "n": "ен"}, "greek": {"f": "να", "m": "ος", "n": "ιδ"}}
NAME_SYLLABLES = 6
_LETTERS = "abcdefghijklmnopqrstuvwxyz"


def session_key(spark: SparkSession) -> str:
    """The key of KEY_SETTING; where there is none, a random one is drawn and kept for the session."""
    key = spark.conf.get(KEY_SETTING, None)
    if not key:
        key = secrets.token_hex(32)
        spark.conf.set(KEY_SETTING, key)
    return key


def _hash(key: str, *parts: Column) -> Column:
    """Keyed, nested SHA-2 in hex."""
    message = F.concat_ws("\x1f", *parts)
    return F.sha2(F.concat(F.lit(f"{key}\x1e"), F.sha2(F.concat(F.lit(f"{key}\x1d"), message), 512)), 512)


def _keyed_number(key: str, *parts: Column) -> Column:
    """60 keyed bits."""
    return F.conv(F.substring(F.sha2(F.concat_ws("\x1f", F.lit(key), *parts), 256), 1, 15), 16, 10).cast("long")


def _number(h: Column, i: Column | int, n: int) -> Column:
    """The i-th (from 0) three hex digits of h, modulo n."""
    i = F.lit(i) if isinstance(i, int) else i
    return F.conv(F.substring(h, i * 3 + 1, F.lit(3)), 16, 10).cast("int") % n


def _pick(h: Column, i: Column | int, letters: str) -> Column:
    return F.substring(F.lit(letters), _number(h, i, len(letters)) + 1, F.lit(1))


def _let(value: Column, use) -> Column:
    """use(value) with the value computed once, however often it is used."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _walk(x: Column, step, good, steps: int = 400) -> Column:
    """step(x), stepped on until `good`: a permutation of what is good where step is one of a larger range."""
    start = F.struct(x.alias("v"), F.lit(False).alias("done"))
    on = lambda s, _: F.when(s["done"], s).otherwise(_let(step(s["v"]), lambda v: F.struct(v.alias("v"), good(v).alias("done"))))
    return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, on, lambda s: s["v"])


def _permuted(digits: Column, key: str, kind: str) -> Column:
    """A keyed permutation of the digit strings of each length of at least 2: modular Feistel rounds over two parts."""

    def turn(s, i):
        mixed = F.pmod(s["a"].cast("long") + _keyed_number(key, F.lit(kind), i.cast("string"), F.length(s["a"]).cast("string"), s["b"]), F.pow(F.lit(10.0), F.length(s["a"])).cast("long"))
        return F.struct(s["b"].alias("a"), F.lpad(mixed.cast("string"), F.length(s["a"]), F.lit("0")).alias("b"))

    def rounds(d):
        left = F.floor(F.length(d) / 2).cast("int")
        start = F.struct(F.substring(d, F.lit(1), left).alias("a"), F.substring(d, left + 1, F.length(d) - left).alias("b"))
        return F.when(F.length(d) < 2, d).otherwise(F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, turn, lambda s: F.concat(s["a"], s["b"])))

    return _let(digits, rounds)


def _luhn_sum(digits: Column) -> Column:
    """Sum of the digits with every second from the right doubled."""
    n = F.length(digits)
    place = F.transform(F.sequence(F.lit(1), n), lambda i: F.substring(digits, i, F.lit(1)).cast("int") * F.when((n - i) % 2 == 1, 2).otherwise(1))
    return F.aggregate(place, F.lit(0), lambda a, v: a + F.when(v > 9, v - 9).otherwise(v))


def _card(form: Column, key: str) -> Column:
    """First digit and distance from the valid check digit stay."""
    n = F.length(form)
    due = lambda body: (10 - _luhn_sum(F.concat(body, F.lit("0"))) % 10) % 10
    body = F.substring(form, F.lit(1), n - 1)
    last = lambda new: F.pmod(due(new) + F.substring(form, -1, 1).cast("int") - due(body), F.lit(10)).cast("string")
    return _let(F.concat(F.substring(form, 1, 1), _permuted(F.substring(form, F.lit(2), n - 2), key, "card")), lambda new: F.concat(new, last(new)))


def _phone(form: Column, key: str) -> Column:
    """The sign and the first digits of an international number stay; a number that begins with 2 to 9 keeps doing so."""
    kept = F.when(form.startswith("+1"), 2).when(form.startswith("+"), 3).otherwise(0)
    high = lambda v: F.substring(v, 1, 1) >= "2"
    moved = lambda rest: _walk(rest, lambda v: _permuted(v, key, "phone"), lambda v: high(v) == high(rest))
    return _let(kept, lambda k: F.concat(F.substring(form, F.lit(1), k), _let(F.substring(form, k + 1, F.length(form) - k), moved)))


def _iban(form: Column, key: str) -> Column:
    """Country and distance from the valid check digits stay; digits are permuted, letters shifted by what the digits were."""
    country, check = F.substring(form, 1, 2), F.substring(form, 3, 2).cast("int")

    def moved(body):
        digits = F.regexp_replace(body, "[^0-9]", "")
        at = lambda i: F.substring(body, i, F.lit(1))
        letter = lambda h, i: F.char(F.lit(65) + F.pmod(F.ascii(at(i)) - 65 + _number(h, i, 26), F.lit(26)))
        shifted = lambda h: F.array_join(F.transform(F.sequence(F.lit(1), F.length(body)), lambda i: F.when(at(i).rlike("[A-Z]"), letter(h, i)).otherwise("0")), "")
        return _let(digits, lambda d: _fill(_let(_hash(key, F.lit("iban"), d), shifted), _permuted(d, key, "iban"), "[0-9]"))

    def due(own):
        def rest(whole):
            value = lambda i: F.substring(whole, i, F.lit(1))
            return F.aggregate(F.sequence(F.lit(1), F.length(whole)), F.lit(0), lambda r, i: F.when(value(i).rlike("[0-9]"), (r * 10 + value(i).cast("int")) % 97).otherwise((r * 100 + F.ascii(value(i)) - 55) % 97))

        return 98 - _let(F.concat(own, country, F.lit("00")), rest)

    checked = lambda body, new: F.concat(country, F.lpad(F.pmod(due(new) + check - due(body), F.lit(100)).cast("string"), 2, "0"), new)
    return _let(F.substring(form, F.lit(5), F.length(form) - 4), lambda body: _let(moved(body), lambda new: checked(body, new)))


#: Ranges that addresses stay in: (first, bits).
_RANGES = ((10 << 24, 24), (127 << 24, 24), ((172 << 24) + (16 << 16), 20), ((192 << 24) + (168 << 16), 16), ((169 << 24) + (254 << 16), 16))


def _ip(form: Column, key: str) -> Column:
    """Private ranges stay private, public addresses public; no address stays the same."""

    def feistel(x, half, back):
        """Rounds over two halves of `half` bits, forth or back."""
        size = 1 << half

        def turn(s, i):
            r = _keyed_number(key, F.lit(f"ip{half}"), i.cast("string"), (s["r"] if not back else s["l"]).cast("string")) % size
            return F.struct(s["l"].bitwiseXOR(r).alias("r"), s["r"].alias("l")) if not back else F.struct(s["l"].alias("r"), s["r"].bitwiseXOR(r).alias("l"))

        order = F.sequence(F.lit(1), F.lit(ROUNDS)) if not back else F.sequence(F.lit(ROUNDS), F.lit(1), F.lit(-1))
        start = F.struct((x % size).alias("r"), F.floor(x / size).cast("long").alias("l"))
        return F.aggregate(order, start, turn, lambda s: s["l"] * size + s["r"])

    def cycle(x, bits):
        """One cycle through all numbers of so many bits."""
        return feistel((feistel(x, bits // 2, False) + 1) % (1 << bits), bits // 2, True)

    within = lambda x, first, bits: (x >= first) & (x < first + (1 << bits))

    def group(x):
        out = F.when((x < 1 << 24) | (x >= 224 << 24), 1)
        for i, (first, bits) in enumerate(_RANGES):
            out = out.when(within(x, first, bits), i + 2)
        return out.otherwise(0)

    def moved(number, own):
        out = F.when(own < 2, _walk(number, lambda v: cycle(v, 32), lambda v: group(v) == own))
        for i, (first, bits) in enumerate(_RANGES):
            out = out.when(own == i + 2, cycle(number - first, bits) + first)
        return out

    parts = lambda p: sum((F.get(p, F.lit(i)).cast("long") * (1 << (24 - 8 * i)) for i in range(4)), F.lit(0).cast("long"))
    written = lambda x: F.concat_ws(".", *((F.floor(x / (1 << (24 - 8 * i))) % 256).cast("long").cast("string") for i in range(4)))
    return _let(_let(F.split(form, r"\."), parts), lambda number: _let(_let(group(number), lambda own: moved(number, own)), written))


def _shape(h: Column, text: Column) -> Column:
    """Letters for letters and digits for digits (lower case); other characters stay."""
    each = F.transform(F.sequence(F.lit(1), F.length(text)), lambda i: F.struct(i.alias("i"), F.substring(text, i, F.lit(1)).alias("c")))
    place = lambda x: (x["i"] - 1) % 42
    return F.array_join(F.transform(each, lambda x: F.when(x["c"].rlike(r"\p{L}"), _pick(h, place(x), _LETTERS)).when(x["c"].rlike(r"\p{N}"), _pick(h, place(x), "0123456789")).otherwise(x["c"])), "")


def _email(form: Column, attempt: Column, key: str) -> Column:
    local = lambda h: F.concat(_shape(h, F.substring_index(form, "@", 1)), F.when(attempt > 0, F.concat(*(_pick(h, 36 + i, _LETTERS) for i in range(6)))).otherwise(""))
    domain = lambda h: F.concat(*(_pick(h, i, _LETTERS) for i in range(8)))
    tld = F.when(F.substring_index(form, ".", -1).isin("org", "net"), F.substring_index(form, ".", -1)).otherwise("com")
    return F.concat(_let(_hash(key, F.lit("email"), form, attempt.cast("string")), local), F.lit("@"), _let(_hash(key, F.lit("domain"), F.substring_index(form, "@", -1)), domain), F.lit(".example."), tld)


def _script(name: Column) -> Column:
    return F.when(name.rlike(r"^\p{IsCyrillic}"), "cyrillic").when(name.rlike(r"^\p{IsGreek}"), "greek").otherwise("latin")


def _stem(name: Column, attempt: Column, key: str) -> Column:
    """NAME_SYLLABLES syllables in the script of the name: longer or shorter with an ending, so stems differ if and only if names do."""

    def stem(h):
        out = None
        for kind, syllables in SYLLABLES.items():
            each = F.array(*map(F.lit, syllables.split(" ")))
            value = F.concat(*(F.element_at(each, _number(h, i, len(syllables.split(" "))) + 1) for i in range(NAME_SYLLABLES)))
            out = F.when(_script(name) == kind, value) if out is None else out.when(_script(name) == kind, value)
        return out

    return _let(_hash(key, F.lit("name"), name, attempt.cast("string")), stem)


def _ending(name: Column, gender: Column) -> Column:
    out = None
    for kind, by in ENDINGS.items():
        value = F.when(gender == "f", by["f"]).when(gender == "m", by["m"]).when(gender == "n", by["n"]).otherwise("")
        out = F.when(_script(name) == kind, value) if out is None else out.when(_script(name) == kind, value)
    return out


def kind_of(e: Column) -> Column:
    out = F.when(F.contains(e, F.lit("@")), "email")
    for kind in ("ipv4", "ssn", "iban", "card"):
        out = out.when(e.rlike(f"^(?:{KINDS[kind]})$"), kind)
    return out.otherwise("phone")


def canonical(e: Column, kind: Column) -> Column:
    """What all ways to write an entity share."""
    return (
        F.when(kind == "email", F.lower(e))
        .when(kind == "ipv4", e)
        .when(kind == "iban", F.replace(e, F.lit(" "), F.lit("")))
        .when(kind == "phone", F.concat(F.when(e.startswith("+"), "+").otherwise(""), F.regexp_replace(e, "[^0-9]", "")))
        .otherwise(F.regexp_replace(e, "[^0-9]", ""))
    )


def _fill(original: Column, letters: Column, what: str) -> Column:
    """`original` with its characters that match `what` replaced one by one by those of `letters`."""
    chars = F.transform(F.sequence(F.lit(1), F.length(original)), lambda i: F.substring(original, i, F.lit(1)))
    start = F.struct(F.lit("").alias("s"), F.lit(1).alias("k"))
    step = lambda a, c: F.when(c.rlike(what), F.struct(F.concat(a["s"], F.substring(letters, a["k"], F.lit(1))).alias("s"), (a["k"] + 1).alias("k"))).otherwise(F.struct(F.concat(a["s"], c).alias("s"), a["k"].alias("k")))
    return F.aggregate(chars, start, step, lambda a: a["s"])


def _render(original: Column, kind: Column, form: Column) -> Column:
    """The canonical surrogate in the format of one occurrence."""
    upper = F.when((original == F.upper(original)) & original.rlike(r"\p{L}"), F.upper(form)).otherwise(form)
    return F.when(kind == "email", upper).when(kind == "ipv4", form).when(kind == "iban", _fill(original, form, "[A-Z0-9]")).otherwise(_fill(original, F.replace(form, F.lit("+"), F.lit("")), "[0-9]"))


def persons(text: Column) -> Column:
    """The name words of a text's titled persons, lower case, with the gender that its titles give to given names ('' for
    last names, which have no ending), as an array of structs without repeats of a word."""
    mentions = F.regexp_extract_all(text, F.lit(PERSON), F.lit(0))

    def words(m):
        gender = F.when(m.rlike(f"^(?:{_WOMEN}) "), "f").when(m.rlike(f"^(?:{_MEN}) "), "m").otherwise("n")
        own = F.regexp_extract_all(F.regexp_replace(m, rf"^(?:{_NEUTRAL}|{_WOMEN}|{_MEN}) ", ""), F.lit(_NAME), F.lit(0))
        return F.transform(own, lambda w, i: F.struct(F.lower(w).alias("name"), F.when((F.size(own) > 1) & (i == 0), gender).otherwise("").alias("gender")))

    every = F.flatten(F.transform(mentions, words))
    names = F.array_distinct(F.transform(every, lambda x: x["name"]))
    told = lambda n, g: F.exists(every, lambda x: (x["name"] == n) & (x["gender"] == g))
    return F.transform(names, lambda n: F.struct(n.alias("name"), _gender(lambda g: told(n, g)).alias("gender")))


def _gender(told) -> Column:
    """The gender of a name by told(g), whether any title tells g: titles that tell one win over those that don't, and either over
    no ending; where some tell one and some the other it is n."""
    return F.when(told("f") & told("m"), "n").when(told("f"), "f").when(told("m"), "m").when(told("n"), "n").otherwise("")


def exceptions(docs: DataFrame, key: str) -> DataFrame | None:
    """canon, attempt, gender of the mail addresses and name words whose first surrogate clashes, and of name words that have
    one gender in one document and another in the next; None if there are none."""
    text = F.col("text")
    mails = docs.where(F.contains(text, F.lit("@"))).select(F.explode(F.regexp_extract_all(text, F.lit(EMAIL), F.lit(0))).alias("e")).select(F.concat(F.lit("email:"), F.lower("e")).alias("canon"), F.lit("").alias("gender"))
    names = docs.where(text.rlike(PERSON)).select(F.explode(persons(text)).alias("p")).select(F.concat(F.lit("name:"), F.col("p.name")).alias("canon"), "p.gender")
    seen = mails.unionByName(names).groupBy("canon").agg(*(F.max(F.col("gender") == g).alias(f"told_{g}") for g in ("f", "m", "n", "")))
    mixed = sum((F.col(f"told_{g}").cast("int") for g in ("f", "m", "n", "")), F.lit(0)) > 1
    own = stage(seen.select("canon", _gender(lambda g: F.col(f"told_{g}")).alias("gender"), mixed.alias("mixed")), "entities")
    todo, good = own, None
    later = None if own.where("mixed").isEmpty() else own.limit(0).select("canon", F.lit(0).alias("attempt"), "gender")
    form = F.regexp_replace("canon", "^[a-z]+:", "")
    for attempt in range(ATTEMPTS):
        n = F.lit(attempt)
        surrogate = F.when(F.col("canon").startswith("email:"), F.concat(F.lit("email:"), _email(form, n, key))).otherwise(F.concat(F.lit("name:"), _stem(form, n, key), _ending(form, F.col("gender"))))
        proposed = stage(todo.select("*", surrogate.alias("s")), "proposed")
        free = proposed.join(own.select(F.col("canon").alias("s")), "s", "left_anti")
        if good is not None:
            free = free.join(good, "s", "left_anti")
        first = free.groupBy("s").agg(F.min(F.struct("canon", "gender", "mixed")).alias("e")).select("s", "e.*")
        todo = stage(todo.join(first.select("canon"), "canon", "left_anti"), "todo")
        good = first.select("s") if good is None else good.unionByName(first.select("s"))
        if attempt or later is not None:
            won = (first if attempt else first.where("mixed")).select("canon", n.alias("attempt"), "gender")
            later = won if later is None else later.unionByName(won)
        if not todo.take(1):
            return later
        good = stage(good, "taken")
    raise ValueError(f"some names have no surrogate of their own after {ATTEMPTS} attempts")


def replaced(text: Column, attempts: Column | None, key: str) -> Column:
    """text with every entity replaced; attempts: map of canonical form to (attempt, gender), or None where all are 0."""
    tried = lambda kind, form: F.lit(0) if attempts is None else F.coalesce(attempts[F.concat(F.lit(f"{kind}:"), form)]["attempt"], F.lit(0))

    def formed(e, kind, form):
        other = F.when(kind == "email", _email(form, tried("email", form), key)).when(kind == "ipv4", _ip(form, key)).when(kind == "iban", _iban(form, key)).when(kind == "card", _card(form, key)).when(kind == "phone", _phone(form, key)).otherwise(_permuted(form, key, "ssn"))
        return _let(other, lambda x: _render(e, kind, x))

    def new(e):
        return _let(kind_of(e), lambda kind: _let(canonical(e, kind), lambda form: formed(e, kind, form)))

    found = F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0))
    gaps = F.split(text, PATTERN, -1)
    joined = F.array_join(F.flatten(F.zip_with(gaps, F.transform(found, new), lambda g, s: F.array(g, F.coalesce(s, F.lit(""))))), "")
    return F.when(text.rlike(PATTERN), joined).otherwise(text)


def renamed(text: Column, parts: Column, attempts: Column | None, key: str) -> Column:
    """text with the capitalised words that are name words (parts: map of word to gender, over which that in attempts goes)
    replaced."""

    def other(w, name):
        how = F.lit(None).cast("struct<attempt:int,gender:string>") if attempts is None else attempts[F.concat(F.lit("name:"), name)]
        n, gender = F.coalesce(how["attempt"], F.lit(0)), F.coalesce(how["gender"], parts[name])
        cased = lambda form: F.when((F.length(w) > 1) & (w == F.upper(w)), F.upper(form)).otherwise(F.initcap(form))
        return _let(F.concat(_stem(name, n, key), _ending(name, gender)), cased)

    def new(w):
        return F.when(F.map_contains_key(parts, F.lower(w)), _let(F.lower(w), lambda name: other(w, name))).otherwise(w)

    word = rf"(?<!\p{{L}}){_NAME}(?!\p{{L}})"
    gaps, words = F.split(text, word, -1), F.regexp_extract_all(text, F.lit(word), F.lit(0))
    return F.array_join(F.flatten(F.zip_with(gaps, F.transform(words, new), lambda g, s: F.array(g, F.coalesce(s, F.lit(""))))), "")


def replace_pii(docs: DataFrame, key: str) -> DataFrame:
    """docs with personal data in `text` replaced (and n_chars, where there is such a column, that of the new text).

    Other columns stay as they are, whatever their names; a null text stays null, an empty one empty; equal rows stay equal;
    a null doc_id is an id like others; an empty table gives no rows; long texts are treated whole. The same entity gets the
    same surrogate in all documents, different entities different ones. Without a key the surrogates could be enumerated, so
    an empty one is an error.
    """
    if not key:
        raise ValueError(f"surrogates need a secret key, as in {KEY_SETTING}")
    rows = docs.select(F.struct("*").alias("row"))
    later = exceptions(docs.select(F.col("text").cast("string").alias("text")), key)
    attempts = None
    if later is not None:
        ids = docs.select(F.col("doc_id").alias("d"), F.xxhash64("text").alias("t"), F.col("text").cast("string").alias("text"))
        mails = F.transform(F.regexp_extract_all("text", F.lit(EMAIL), F.lit(0)), lambda e: F.concat(F.lit("email:"), F.lower(e)))
        names = F.transform(persons(F.col("text")), lambda p: F.concat(F.lit("name:"), p["name"]))
        canon = F.array_distinct(F.concat(F.when(F.contains("text", F.lit("@")), mails).otherwise(F.array()), F.when(F.col("text").rlike(PERSON), names).otherwise(F.array())))
        has = ids.where(F.contains("text", F.lit("@")) | F.col("text").rlike(PERSON)).select("d", "t", F.explode(canon).alias("canon")).distinct()
        salted = later.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))  # a name may be in most documents
        met = has.withColumn("salt", F.pmod(F.xxhash64("d", "t"), F.lit(SALTS)).cast("int")).join(salted, ["canon", "salt"])
        maps = met.groupBy("d", "t").agg(F.map_from_entries(F.collect_list(F.struct("canon", F.struct("attempt", "gender").alias("how")))).alias("attempts"))
        rows = rows.join(maps, F.col("row.doc_id").eqNullSafe(F.col("d")) & (F.xxhash64("row.text") == F.col("t")), "left")
        attempts = F.col("attempts")
    text = F.col("row.text").cast("string")
    named = F.when(text.rlike(PERSON), F.map_from_entries(F.transform(persons(text), lambda p: F.struct(p["name"], p["gender"]))))
    out = rows.select("row", *([] if attempts is None else ["attempts"]), named.alias("parts"), replaced(text, attempts, key).alias("new"))
    out = out.select("row", F.when(F.col("parts").isNotNull(), renamed(F.col("new"), F.col("parts"), attempts, key)).otherwise(F.col("new")).alias("new"))
    fields = [F.col("new").alias(c) if c == "text" else F.char_length("new").cast(t).alias(c) if c == "n_chars" else F.col(f"row.`{c}`").alias(c) for c, t in docs.dtypes]
    return out.select(*fields)


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return replace_pii(docs, session_key(spark))
