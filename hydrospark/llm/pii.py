"""Surrogates for personal data, in DataFrame functions only.

Detected entities are replaced by keyed surrogates of their own type: the same entity gets the same
surrogate in every document, two entities never share one, and none equals an entity of the corpus.
Digits stay digits and letters letters, so formats hold; card numbers pass their check digit, given
names keep the gender of the form of address, names keep their script.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hydrospark.llm.shared import staged

_OPEN, _CLOSE, _OTHER = "\ue000", "\ue001", "\ufffd"

# Forms of address by gender, and given names by script and gender.
MALE = ("Mr", "Herr", "Herrn", "Señor", "Monsieur", "Господин")
FEMALE = ("Mrs", "Ms", "Miss", "Frau", "Señora", "Señorita", "Madame", "Mademoiselle", "Госпожа")
GIVEN = {
    ("latin", "m"): ("Adrian", "Bruno", "Carlos", "David", "Emil", "Felix", "Gabriel", "Hugo", "Ivan", "Julian",
                     "Kurt", "Lucas", "Martin", "Nicolas", "Oscar", "Pablo", "Robert", "Simon", "Thomas", "Victor"),
    ("latin", "f"): ("Alma", "Beatrice", "Clara", "Diana", "Elena", "Flora", "Greta", "Helena", "Irene", "Julia",
                     "Karin", "Laura", "Marta", "Nora", "Olivia", "Paula", "Rosa", "Sofia", "Teresa", "Vera"),
    ("cyrillic", "m"): ("Андрей", "Борис", "Виктор", "Григорий", "Дмитрий", "Егор", "Иван", "Кирилл", "Максим", "Павел"),
    ("cyrillic", "f"): ("Алина", "Вера", "Галина", "Дарья", "Елена", "Инна", "Лариса", "Мария", "Ольга", "Татьяна"),
}
#: Sixteen syllables of surnames by script; a surname takes four by hash and more where names collide.
SYLLABLES = {"latin": ("ba", "de", "fi", "go", "hu", "ka", "le", "mi", "no", "pu", "ra", "se", "ti", "vo", "wu", "za"),
             "cyrillic": ("ба", "де", "фи", "го", "ху", "ка", "ле", "ми", "но", "пу", "ра", "се", "ти", "во", "ву", "за")}

_TITLE = rf"(?:{'|'.join(MALE + FEMALE)})\.?"
_NAME = r"\p{Lu}(?:\p{L}|-(?=\p{L})|['’](?=\p{L})(?!s(?!\p{L})))++"
_BETWEEN = r"(?: \p{Lu}\.?(?= ))*(?: (?:von|van|vom|zu|zum|zur|der|den|ter|de|del|della|di|da|dos|du|la|le|los|las|al|bin|ibn|y)(?= ))*"
_IP = r"(?<![0-9.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![0-9]|\.[0-9])"
_CARD = r"(?<![0-9])[0-9]{4}(?:[ -]?[0-9]{4}){3}(?![0-9])"
_SSN = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"
_THREES = r"(?:[0-9]{3}-[0-9]{3}-[0-9]{4}|[0-9]{3}\.[0-9]{3}\.[0-9]{4}|[2-9][0-9]{2} [0-9]{3} [0-9]{4})(?![0-9]|[.-][0-9])"
_FRONT = r"(?<![0-9A-Za-z+]|[0-9A-Za-z][.-])"
# Where a further group of a phone may not begin, as another number does: an address, a card that is not itself in
# the middle of a row of fours, a number with a decimal point, a social security number, another phone.
_OTHER_NUMBER = (rf"{_IP}|{_CARD}(?![ -][0-9]{{4}}(?![0-9]))|(?<=\x20)[0-9]+\.[0-9]+(?![0-9]|[. -][0-9])"
                 rf"|(?<=\x20)(?:{_SSN}|{_THREES})")
_GROUP = rf"(?:[ .-]?(?!{_OTHER_NUMBER})[0-9]{{2,4}})"
PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]+)+",
    "ip": _IP,
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "card": _CARD,
    "ssn": _SSN,
    # formats with a length of their own first, then with a country code or brackets, then with a leading 0
    "phone": r"(?:\+[0-9]{1,3}[ .-]?)?\([0-9]{3}\)[ .-]?[0-9]{3}[ .-][0-9]{4}(?![0-9])"
             r"|(?<![0-9A-Za-z])\+1[ .-]?[0-9]{3}[ .-]?[0-9]{3}[ .-]?[0-9]{4}(?![0-9])"
             rf"|(?:\+[0-9]{{1,3}}[ .-]?)?\([0-9]{{2,4}}\)[ .-]?(?!{_IP}|{_CARD})[0-9]{{2,4}}{_GROUP}{{1,3}}(?![0-9])"
             rf"|(?<![0-9A-Za-z])\+[0-9]{{1,3}}(?:[ .-]?[0-9]{{2,4}}){{2}}{_GROUP}{{0,3}}(?![0-9])"
             rf"|{_FRONT}(?:1[ .-])?{_THREES}"
             rf"|{_FRONT}0[1-9](?:(?: [0-9]{{2}}){{4}}|(?:\.[0-9]{{2}}){{4}}|(?:-[0-9]{{2}}){{4}})(?![0-9]|[.-][0-9])"
             rf"|{_FRONT}0[1-9][0-9]{{0,3}}[ /-](?:[0-9]{{5,8}}|[0-9]{{3,4}}(?:[ -](?!{_OTHER_NUMBER})[0-9]{{2,4}}){{1,3}})(?![0-9]|[.-][0-9])",
    "person": rf"(?<!\p{{L}}){_TITLE}(?:{_BETWEEN} {_NAME})++",
}
_ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())
_HINT = rf"[0-9@]|{_TITLE} "


def _let(value: Column, use) -> Column:
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _titled(entity: Column) -> Column:
    return entity.rlike(f"^{_TITLE} ")


def _is_name(word: Column) -> Column:
    """A word of a person's name that is no initial and no particle."""
    return word.rlike(rf"^{_NAME}$")


def _parts(text: Column) -> Column:
    """The text as an array in which every second entry is an entity; one entry where there is none.

    Where persons are named by form of address, their surnames are entities wherever else they stand, with
    given names of those persons in front.
    """
    plain = F.translate(text, _OPEN + _CLOSE, _OTHER * 2)

    def cut(pattern: Column) -> Column:
        return F.split(F.regexp_replace(plain, pattern, F.lit(f"{_OPEN}$0{_CLOSE}")), f"[{_OPEN}{_CLOSE}]", -1)

    def spelled(names: Column) -> Column:
        return F.array_join(F.array_distinct(F.concat(names, F.transform(names, F.upper))), "|")

    def with_mentions(people: Column) -> Column:
        last = F.transform(people, lambda p: F.substring_index(p, " ", -1))
        rest = F.flatten(F.transform(people, lambda p: F.filter(
            F.split(p, " ", -1), lambda w, i: (i > 0) & (i < F.size(F.split(p, " ", -1)) - 1) & _is_name(w))))
        front = F.when(F.size(rest) > 0, F.concat(F.lit("(?:(?:"), spelled(rest), F.lit(") )*"))).otherwise(F.lit(""))
        return cut(F.concat(F.lit(_ANY + r"|(?<!\p{L})"), front, F.lit("(?:"), spelled(last), F.lit(r")(?!\p{L}|-\p{L})")))

    def again(parts: Column) -> Column:
        people = F.filter(_entities(parts), _titled)
        return F.when(F.size(people) > 0, _let(people, with_mentions)).otherwise(parts)

    return F.when(text.rlike(_HINT), _let(cut(F.lit(_ANY)), again)).otherwise(F.array(text))


def kind_of(entity: Column) -> Column:
    out = F.when(entity.rlike(f"^(?:{PATTERNS['email']})$"), F.lit("email"))
    for kind in ("ip", "iban", "card", "ssn"):
        out = out.when(entity.rlike(f"^(?:{PATTERNS[kind]})$"), F.lit(kind))
    return out.when(entity.rlike("^[+(0-9]"), F.lit("phone")).otherwise(F.lit("person"))


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def _script(name: Column) -> Column:
    return F.when(name.rlike(r"\p{IsCyrillic}"), F.lit("cyrillic")).otherwise(F.lit("latin"))


def keys_of(entity: Column) -> Column:
    """What of an entity is replaced, as (kind, key) pairs: spellings of one thing have one key.

    A person's surname and given names are keys of their own, so that later mentions by surname agree; a mention
    without form of address has no key but the surname.
    """
    kind = kind_of(entity)
    plain = (F.when(kind == "email", F.lower(entity)).when(kind == "ip", entity)
             .when(kind == "iban", F.translate(entity, " ", "")).otherwise(_digits(entity)))
    words = F.split(entity, " ", -1)
    gender = F.when(F.regexp_replace(F.get(words, F.lit(0)), r"\.$", "").isin(*MALE), F.lit("m")).otherwise(F.lit("f"))
    rest = F.filter(words, lambda w, i: (i > 0) & (i < F.size(words) - 1) & _is_name(w))
    return F.when(kind != "person", F.array(F.struct(kind.alias("kind"), plain.alias("key")))).otherwise(F.concat(
        F.when(_titled(entity), F.transform(rest, lambda w: _given(w, gender))).otherwise(F.array().cast(_PAIRS)),
        F.array(_surname(F.get(words, F.size(words) - 1)))))


_PAIRS = "array<struct<kind:string,key:string>>"


def _surname(name: Column) -> Column:
    return F.struct(F.concat(F.lit("surname_"), _script(name)).alias("kind"), F.lower(name).alias("key"))


def _given(name: Column, gender: Column) -> Column:
    return F.struct(F.concat(F.lit("given_"), _script(name), F.lit("_"), gender).alias("kind"), F.lower(name).alias("key"))


def _hash(secret: str) -> Column:
    return F.sha2(F.concat_ws("|", F.lit(secret), F.col("kind"), F.col("key"), F.col("attempt")).cast("binary"), 256)


def _filled(shape: Column, letters: Column, digits: Column) -> Column:
    """The shape with its letters and digits replaced in turn, other characters kept."""
    def step(done: Column, c: Column) -> Column:
        new = F.when(c.rlike("[0-9]"), F.substring(digits, done["n"] % 60 + 1, F.lit(1))) \
            .when(c.rlike("[A-Za-z]"), F.substring(letters, done["n"] % 60 + 1, F.lit(1)))
        return F.struct(F.concat(done["out"], F.coalesce(new, c)).alias("out"), (done["n"] + 1).alias("n"))

    return F.aggregate(F.split(shape, "", -1), F.struct(F.lit("").alias("out"), F.lit(0).alias("n")), step,
                       lambda done: done["out"])


def _luhn(front: Column) -> Column:
    """Fifteen digits and the digit that makes them a valid card number."""
    def step(total: Column, i: Column) -> Column:
        d = F.substring(front, i + 1, F.lit(1)).cast("int") * F.when(i % 2 == 0, F.lit(2)).otherwise(F.lit(1))
        return total + F.when(d > 9, d - 9).otherwise(d)

    total = F.aggregate(F.sequence(F.lit(0), F.lit(14)), F.lit(0), step)
    return F.concat(front, F.pmod(10 - total % 10, F.lit(10)).cast("string"))


def _surrogate(secret: str) -> Column:
    """The candidate for (kind, key) at an attempt."""
    h = _hash(secret)
    digits, letters = F.translate(h, "abcdef", "012345"), F.translate(h, "0123456789", "ghijklmnop")
    nibble = [F.conv(F.substring(h, i + 1, 1), 16, 10).cast("int") for i in range(8)]
    key, kind = F.col("key"), F.col("kind")
    local, tail = F.substring_index(key, "@", 1), F.translate(F.substring(h, 50, 4), "abcdef", "012345")
    email = F.concat(_filled(local, letters, digits), F.when(F.length(local) < 8, tail).otherwise(F.lit("")),
                     F.when(F.col("attempt") > 0, F.concat(F.lit("."), F.substring(letters, 40, 8))).otherwise(F.lit("")),
                     F.lit("@mail"), F.substring(digits, 60, 2), F.lit(".example.net"))
    octets = F.concat_ws(".", *[(F.conv(F.substring(h, 2 * i + 1, 2), 16, 10).cast("int") % 254 + 1).cast("string")
                                for i in range(4)])
    front = F.concat(F.substring(key, 1, 1), F.substring(digits, 1, 14))
    zero = ((kind == "phone") & key.startswith("0")).cast("int")  # of a national number
    keep = F.when(F.length(key) > 10, F.length(key) - 10).otherwise(zero)
    numbers = F.concat(F.substring(key, F.lit(1), keep), F.substring(digits, F.lit(1), F.length(key) - keep))
    iban = F.concat(F.substring(key, 1, 2), _filled(F.expr("substring(key, 3)"), F.upper(letters), digits))
    out = (F.when(kind == "email", email).when(kind == "ip", octets).when(kind == "card", _luhn(front))
           .when(kind == "iban", iban).when(kind.isin("phone", "ssn"), numbers))
    for script, syllables in SYLLABLES.items():
        table = F.array(*map(F.lit, syllables))
        name = F.concat(*[F.get(table, n) for n in nibble[:4]])
        more = F.concat(*[F.get(table, n) for n in nibble[4:]])
        out = out.when(kind == f"surname_{script}", F.initcap(F.concat(
            name, F.when(F.col("attempt") > 0, more).otherwise(F.lit("")))))
    for (script, gender), names in GIVEN.items():
        table = F.array(*map(F.lit, names))
        picks = [F.get(table, F.conv(F.substring(h, 4 * i + 1, 4), 16, 10).cast("int") % len(names)) for i in range(8)]
        # a list of names is short: a name that is taken is drawn again with one more part
        out = out.when(kind == f"given_{script}_{gender}", F.array_join(F.slice(
            F.array(*picks), F.lit(1), F.least(F.col("attempt") + 1, F.lit(8))), "-"))
    return out


def surrogates(entities: DataFrame, secret: str) -> DataFrame:
    """(kind, key, surrogate) for every distinct (kind, key): one to one within a kind.

    Each round draws a candidate by keyed hash; it is refused if an entity of the corpus or an
    earlier surrogate has it, and of keys that draw the same one the smallest keeps it. The others draw
    again, so rounds end as soon as nothing collides.
    """
    left = staged(entities.select("kind", "key").distinct().withColumn("attempt", F.lit(0)), "entities")
    originals = left.select("kind", F.lower("key").alias("taken"))
    done = None
    while True:
        drawn = left.withColumn("surrogate", _surrogate(secret)).withColumn("taken", F.lower("surrogate"))
        used = originals if done is None else originals.unionByName(done.select("kind", F.lower("surrogate").alias("taken")))
        free = drawn.join(used.distinct(), ["kind", "taken"], "left_anti")
        won = free.groupBy("kind", "taken").agg(F.min("key").alias("key"))
        settled = staged(free.join(won, ["kind", "taken", "key"]).select("kind", "key", "surrogate"), "surrogates")
        left = staged(left.join(settled, ["kind", "key"], "left_anti")
                      .withColumn("attempt", F.col("attempt") + 1), "entities")
        done = settled if done is None else done.unionByName(settled)
        if not left.limit(1).count():
            return done


def _cased(like: Column, name: Column) -> Column:
    return F.when((F.upper(like) == like) & (F.length(like) > 1), F.upper(name)).otherwise(name)


def _replaced(entity: Column, table: Column) -> Column:
    """The entity written with its surrogates: separators, case and form of address stay."""
    def of(pair: Column) -> Column:
        return F.try_element_at(table, F.concat_ws("|", pair["kind"], pair["key"]))

    def written(keys: Column) -> Column:
        first, words = F.get(keys, F.lit(0)), F.split(entity, " ", -1)
        new, kind, titled = of(first), first["kind"], _titled(entity)
        man = F.regexp_replace(F.get(words, F.lit(0)), r"\.$", "").isin(*MALE)

        def given(w: Column) -> Column:
            m, f = of(_given(w, F.lit("m"))), of(_given(w, F.lit("f")))
            return F.when(titled, F.when(man, m).otherwise(f)).otherwise(F.coalesce(m, f))

        name = F.array_join(F.transform(words, lambda w, i: F.when((titled & (i == 0)) | ~_is_name(w), w).otherwise(
            _cased(w, F.when(i == F.size(words) - 1, of(_surname(w))).otherwise(given(w))))), " ")
        return (F.when(kind == "email", _cased(entity, new)).when(kind == "ip", new)
                .when(kind.isin("card", "phone", "ssn", "iban"), _spread(entity, new)).otherwise(name))

    return _let(keys_of(entity), written)


def _spread(shape: Column, characters: Column) -> Column:
    """The characters laid over the letters and digits of a shape."""
    def step(done: Column, c: Column) -> Column:
        solid = c.rlike("[0-9A-Za-z]")
        return F.struct(F.concat(done["out"], F.when(solid, F.substring(characters, done["n"] + 1, F.lit(1)))
                                 .otherwise(c)).alias("out"),
                        (done["n"] + solid.cast("int")).alias("n"))

    return F.aggregate(F.split(shape, "", -1), F.struct(F.lit("").alias("out"), F.lit(0).alias("n")), step,
                       lambda done: done["out"])


def _entities(parts: Column) -> Column:
    """Every second entry."""
    return F.filter(parts, lambda p, i: i % 2 == 1)


KINDS = ("email", "phone", "card", "ip", "iban", "ssn", "person")


def pseudonymise(docs: DataFrame, secret: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_found and n_<kind> (long), text with surrogates, changed.

    A text without entities comes back as it is, null as null. Rows with equal text share the work;
    null ids and repeated rows stay rows. Further columns are not read. The two characters that
    mark entities inside are read as U+FFFD in texts that have entities.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"),
                       F.xxhash64(text_col).alias("text_hash"))
    found = staged(rows.where("text is not null").select("doc_id", "text_hash", _entities(_parts(F.col("text"))).alias("entities"))
                   .where(F.size("entities") > 0), "found")
    named = found.select("doc_id", "text_hash", F.explode(F.array_distinct("entities")).alias("entity"))
    keyed = named.select("doc_id", "text_hash", F.explode(keys_of(F.col("entity"))).alias("pair")) \
        .select("doc_id", "text_hash", "pair.kind", "pair.key").distinct()
    table = surrogates(keyed, secret)
    tables = (keyed.join(table, ["kind", "key"]).groupBy("doc_id", "text_hash")
              .agg(F.map_from_entries(F.collect_list(F.struct(F.concat_ws("|", "kind", "key"), "surrogate"))).alias("table"))
              .withColumnsRenamed({"doc_id": "of_id", "text_hash": "of_hash"}))
    has = rows.where(F.col("text").isNotNull() & F.col("text").rlike(_HINT))
    joined = has.join(tables, F.col("doc_id").eqNullSafe(F.col("of_id")) & (F.col("text_hash") == F.col("of_hash")), "left")
    table_ = F.col("table")

    def rewritten(parts: Column) -> Column:
        entities = _entities(parts)
        counts = F.transform(entities, kind_of)
        text = F.array_join(F.transform(parts, lambda p, i: F.when(i % 2 == 1, _replaced(p, table_)).otherwise(p)), "")
        return F.struct(text.alias("text"), F.size(entities).cast("long").alias("n_found"),
                        *[F.size(F.filter(counts, _is(k))).cast("long").alias(f"n_{k}") for k in KINDS])

    zero = F.struct(F.col("text"), F.lit(0).cast("long").alias("n_found"),
                    *[F.lit(0).cast("long").alias(f"n_{k}") for k in KINDS])
    done = joined.select("doc_id", F.when(table_.isNotNull(), _let(_parts(F.col("text")), rewritten)).otherwise(zero).alias("r"),
                         F.col("text").alias("was"))
    plain = rows.where(F.col("text").isNull() | ~F.col("text").rlike(_HINT)).select("doc_id", zero.alias("r"), F.col("text").alias("was"))
    columns = ["doc_id", "r.n_found", *[f"r.n_{k}" for k in KINDS], "r.text", (~F.col("r.text").eqNullSafe(F.col("was"))).alias("changed")]
    return reduce(DataFrame.unionByName, [done, plain]).select(*columns)


def _is(kind: str):
    return lambda k: k == kind
