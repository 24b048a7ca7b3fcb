"""Replacement of personal data by keyed surrogates, with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpoint, fits, table

#: Names to draw from, by script and gender; a surname is made of three parts of its script.  None is tied to a person.
GIVEN = {
    "latin": {
        "f": "Ada Alma Anna Bella Clara Dora Edith Elena Ella Emma Eva Frida Greta Hanna Ida Irma Julia Karla Laura Lena Lina Maria Marta Mina Nora Olga Paula Rita Rosa Sara Sofia Vera".split(),
        "m": "Adam Albert Anton Bruno Carl Conrad David Emil Erik Felix Frank Georg Hugo Ivan Jakob Jonas Karl Leon Lukas Martin Max Milan Nils Oscar Otto Paul Peter Robert Simon Thomas Viktor Walter".split(),
    },
    "greek": {
        "f": "Άννα Δήμητρα Ειρήνη Ελένη Ευαγγελία Ζωή Κατερίνα Μαρία Νίκη Όλγα Σοφία Χριστίνα".split(),
        "m": "Αλέξανδρος Ανδρέας Γιάννης Γιώργος Δημήτρης Ηλίας Θωμάς Κώστας Μιχάλης Νίκος Πέτρος Σπύρος".split(),
    },
    "armenian": {
        "f": "Անահիտ Աննա Արմինե Գայանե Լիլիթ Մարիամ Նարե Սիրանուշ".split(),
        "m": "Արամ Արմեն Գևորգ Դավիթ Հակոբ Հայկ Տիգրան Վահան".split(),
    },
    "cyrillic": {
        "f": "Анна Вера Дарья Елена Зоя Инна Ирина Лидия Мария Нина Ольга Раиса Софья Тамара Ульяна Юлия".split(),
        "m": "Антон Борис Вадим Виктор Глеб Денис Егор Иван Кирилл Лев Максим Олег Павел Роман Сергей Юрий".split(),
    },
}
PARTS = {
    "latin": "ba be bo da de do fa fe ga go ha he ka ke ko la le lo ma me mo na ne no ra re ro sa se so ta to".split(),
    "greek": "βα βε βο γα γε δα δε δο κα κε κο λα λε λο μα με μο να νε νο ρα ρε ρο σα σε σο τα το".split(),
    "armenian": "բա բե գա գո դա դե կա կո լա լե մա մե նա նե նո ռա ռե սա սե սո տա տե".split(),
    "cyrillic": "ба бе бо ва ве во га го да де до ка ке ко ла ле ло ма ме мо на не но ра ре ро са се со та то".split(),
}
#: Titles that say a person's name follows, and which gender it has.
TITLES = {"f": "Mrs Ms Miss Mme Mlle Frau Señora Sra Signora госпожа Κυρία Κα Տիկին".split(), "m": "Mr Sir Herr Monsieur Señor Sr Signor господин Κύριος Κος Պարոն".split(), "": "Dr Prof".split()}

_TITLE = "|".join(t for titles in TITLES.values() for t in titles)
_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
_NAME = r"\p{Lu}[\p{L}'’-]*\p{L}"
_INITIAL = r"\p{Lu}\."
#: Small words of surnames, which stay as they are.
PARTICLES = "von van der den de da di del della dos du la le ten ter zu bin ibn al el".split()
_OWN = rf"(?!(?:{_TITLE})\b){_NAME}"
_END = r"(?![\p{L}\p{N}])"
#: Kinds of personal data in the order in which they are tried at a place, all of them after what is no letter or digit
#: (Java patterns without groups).
KINDS = {
    "email": r"(?<![._%+-])[\p{L}\p{N}._%+-]++@[\p{L}\p{N}-]+(?:\.[\p{L}\p{N}-]+)*\.\p{L}{2,}",
    "iban": rf"[A-Z]{{2}}\d{{2}}(?: ?[A-Z0-9]{{4}}){{3,7}}(?: ?[A-Z0-9]{{1,3}})?{_END}",
    "secret": rf"(?:[0-9a-fA-F]{{32,128}}|(?:AKIA|ASIA)[0-9A-Z]{{16}}|gh[pousr]_[0-9A-Za-z]{{36,}}|sk-[0-9A-Za-z_-]{{20,}}){_END}",
    "password": r"(?<=\b(?:password|passwd|pwd) ?[=:] ?['\x22]?)(?=[^\s'\x22,;]*\d)[^\s'\x22,;]{6,}",
    "ip": rf"(?<!\.){_OCTET}(?:\.{_OCTET}){{3}}(?![\p{{L}}\p{{N}}]|\.\d)",
    "ssn": r"(?<!-)\d{3}-\d{2}-\d{4}(?![\p{L}\p{N}]|-\d)",
    "phone": rf"(?<!\+)(?:\+\d{{1,3}}[ .-]?(?:\(\d{{1,4}}\)[ .-]?)?\d{{2,4}}(?:[ .-]?\d{{2,4}}){{1,4}}|\(\d{{2,4}}\) ?\d{{3}}[ .-]\d{{4}}|\d{{3}}[ .-]\d{{3}}[ .-]\d{{4}}){_END}",
    "card": rf"\d{{4}}(?:[ -]?\d{{4}}){{2}}[ -]?\d{{1,7}}{_END}",
    "name": rf"(?:{_TITLE})\b\.?(?: (?:{_TITLE})\b\.?)*(?: (?:{_OWN}|{_INITIAL})){{0,3}}(?: (?:{'|'.join(PARTICLES)})){{0,3}} {_OWN}",
}
#: A full name without a title, at each place where one may begin, of two and of three words.
UNTITLED = [rf"(?<![\p{{L}}\p{{N}}'’-])(?=({_OWN}{f' (?:{_OWN}|{_INITIAL})' * n}(?: (?:{'|'.join(PARTICLES)})){{0,3}} {_OWN}){_END})" for n in (0, 1)]
ANY = r"(?<![\p{L}\p{N}])(?:" + "|".join(KINDS.values()) + ")"
#: What a text with any of them has somewhere, to be looked for first: it costs a tenth.
SCREEN = rf"[0-9@]|[0-9a-fA-F]{{32}}|sk-|(?=[{''.join(sorted({t[0] for ts in TITLES.values() for t in ts}))}])(?:{_TITLE})"
#: Rounds of new surrogates for those that collide; after them a surrogate is made longer, which always ends it.
ROUNDS = 12
#: Between given name and surname in the normal form of a given name.
SEPARATOR = "\x1f"

_HEX = "0123456789abcdef"


def _alternatives(chosen: dict[str, str], value: Column, default: Column) -> Column:
    out = default
    for name, pattern in reversed(chosen.items()):
        out = F.when(value.rlike(f"^(?:{pattern})$"), F.lit(name)).otherwise(out)
    return out


def _digest(key: str, *parts: Column) -> Column:
    """A keyed digest of 64 hexadecimal digits."""
    return F.sha2(F.concat_ws("\x1f", F.lit(key), *parts, F.lit(key)), 256)


def _number(digest: Column, at: Column | int, below: int) -> Column:
    """A number below ``below`` from eight digits of a digest, which is read round and round."""
    at = F.lit(at) if isinstance(at, int) else at
    return F.conv(F.substring(F.concat(digest, digest), (at * 7) % 64 + F.lit(1), F.lit(8)), 16, 10).cast("long") % below


def _pick(values: list[str], number: Column) -> Column:
    return F.get(F.array(*[F.lit(v) for v in values]), number.cast("int"))


def _like(text: Column, digest: Column) -> Column:
    """``text`` with each letter and digit replaced by another of its kind; all else stays."""

    def one(c: Column, i: Column) -> Column:
        n = lambda below: _number(digest, i, below)
        return (
            F.when(c.rlike(r"^\d$"), n(10).cast("string"))
            .when(c.rlike(r"^\p{IsCyrillic}$"), F.substring(F.lit("абвгдежзиклмнопрстуфхцчшэюя"), (n(27) + 1).cast("int"), F.lit(1)))
            .when(c.rlike(r"^\p{IsGreek}$"), F.substring(F.lit("αβγδεζηθικλμνξοπρστυφχψω"), (n(24) + 1).cast("int"), F.lit(1)))
            .when(c.rlike(r"^\p{L}$"), F.substring(F.lit("abcdefghijklmnopqrstuvwxyz"), (n(26) + 1).cast("int"), F.lit(1)))
            .otherwise(c)
        )

    return F.array_join(F.transform(F.split(text, ""), one), "")


def _hex_like(text: Column, digest: Column) -> Column:
    return F.array_join(F.transform(F.split(text, ""), lambda c, i: F.when(c.rlike("^[0-9a-f]$"), _pick(list(_HEX), _number(digest, i, 16))).otherwise(c)), "")


def luhn(digits: Column) -> Column:
    """The digit that a number of cards must end with, after ``digits``."""
    values = F.reverse(F.filter(F.split(digits, ""), lambda c: c != ""))
    doubled = F.transform(values, lambda c, i: F.when(i % 2 == 0, F.when(c.cast("int") > 4, 2 * c.cast("int") - 9).otherwise(2 * c.cast("int"))).otherwise(c.cast("int")))
    total = F.aggregate(doubled, F.lit(0), lambda a, x: a + x)
    return ((10 - total % 10) % 10).cast("string")


def remainder_97(account: Column) -> Column:
    """An account number (lower case, country and check digits first) modulo 97, with letters as 10 to 35."""
    moved = F.filter(F.split(F.concat(F.substring(account, 5, 64), F.substring(account, 1, 4)), ""), lambda c: c != "")
    value = lambda c: F.when(c.rlike("^[0-9]$"), c.cast("long")).otherwise((F.ascii(c) - 87).cast("long"))
    return F.aggregate(moved, F.lit(0).cast("long"), lambda a, c: (a * F.when(value(c) > 9, 100).otherwise(10) + value(c)) % 97)


def is_valid(kind: Column, norm: Column) -> Column:
    """Whether a number's check digits, if its kind has such, are right; other numbers of that form are left alone, but
    for those of 16 digits that begin as cards do: a card with a wrong digit is taken too."""
    card = luhn(F.expr("substring(norm, 1, length(norm) - 1)")) == F.expr("substring(norm, length(norm), 1)")
    return F.when(kind == "card", card | norm.rlike("^[3-6][0-9]{15}$")).when(kind == "iban", remainder_97(norm) == 1).otherwise(F.lit(True))


def script_of(name: Column) -> Column:
    out = F.lit("latin")
    for script in GIVEN:
        if script != "latin":
            out = F.when(name.rlike(rf"\p{{Is{script.capitalize()}}}"), script).otherwise(out)
    return out


def with_surrogates(entities: DataFrame, key: str) -> DataFrame:
    """``entities`` (kind, norm, attempt) with a surrogate in lower case, from a digest of all three.

    norm is an entity's normal form: lower case (but for passwords), and for phones, cards and accounts without separators.
    That of a given name ends with ``SEPARATOR`` and the surname."""
    kind, norm, attempt = F.col("kind"), F.col("norm"), F.col("attempt")
    d = _digest(key, kind, norm, attempt.cast("string"))

    def octet(x: Column, i: Column) -> Column:
        return F.when(F.length(x) == 1, _number(d, i, 10)).when(F.length(x) == 2, _number(d, i, 90) + 10).otherwise(_number(d, i, 156) + 100).cast("string")

    ip = F.array_join(F.transform(F.split(norm, r"\."), octet), ".")
    user, site = F.substring_index(norm, "@", 1), F.substring_index(F.substring_index(norm, "@", -1), ".", 1)
    email = F.concat(_like(user, d), F.lit("@"), _like(site, F.reverse(d)), F.lit(".example."), _pick(["com", "net", "org"], _number(d, 3, 3)))
    surname = F.lit(None).cast("string")
    for script, parts in PARTS.items():
        made = F.concat(*[_pick(parts, _number(d, i, len(parts))) for i in range(1, 4)])
        second = F.concat(*[_pick(parts, _number(d, i, len(parts))) for i in range(4, 6)])
        surname = F.when(script_of(norm) == script, F.when(norm.contains("-"), F.concat(made, F.lit("-"), second)).otherwise(made)).otherwise(surname)
    given = F.lit(None).cast("string")
    for script, genders in GIVEN.items():
        for gender, names in genders.items():
            # one name at first, then two or three in one word, so that a surname with many given names has enough
            more = [F.when(attempt >= least, F.lower(_pick(names, _number(d, at, len(names))))).otherwise("") for at, least in ((4, 4), (6, 8))]
            second = F.when(F.substring_index(norm, SEPARATOR, 1).contains("-"), F.concat(F.lit("-"), _pick(names, _number(d, 6, len(names))))).otherwise("")
            given = F.when(kind == f"given:{script}:{gender}", F.concat(_pick(names, _number(d, 2, len(names))), *more, second)).otherwise(given)
    # a country, what tells the kind of an access key, and the first digit of a card stay
    kept = F.regexp_extract(norm, r"^(\+(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|\d{3}|\d)|\d(?=\d{12,18}$)|akia|asia|gh[pousr]_|sk-|[a-z]{2}(?=\d{2}[a-z0-9]{11,}$))", 0)
    hexadecimal = norm.rlike("^[0-9a-f]{32,}$")
    kept = F.when(kind.isin("phone", "iban", "secret", "card") & ~hexadecimal, kept).otherwise("")
    rest = F.substring(norm, F.length(kept) + 1, F.length(norm))
    like = F.when(hexadecimal, _hex_like(norm, d)).otherwise(F.concat(kept, _like(rest, d)))
    entities = entities.withColumn("_like", like)
    # numbers with check digits get right ones
    body = F.expr("substring(_like, 1, length(_like) - 1)")
    card = F.concat(body, luhn(body))
    country, account = F.substring(norm, 1, 2), F.substring("_like", 5, 64)
    check = F.lpad((98 - remainder_97(F.concat(country, F.lit("00"), account))).cast("string"), 2, "0")
    iban = F.concat(country, check, account)
    made = F.when(kind == "ip", ip).when(kind == "email", email).when(kind == "surname", surname).when(kind.startswith("given"), given).when(kind == "card", card).when(kind == "iban", iban).otherwise(F.col("_like"))
    longer = F.when(kind.isin("card", "iban"), made).otherwise(F.concat(made, F.substring(d, 1, 16)))
    return entities.withColumn("surrogate", F.lower(F.when(attempt <= ROUNDS, made).otherwise(longer))).drop("_like")


def assign(entities: DataFrame, key: str) -> DataFrame:
    """Distinct ``entities`` (kind, norm) with a surrogate each: of a kind, no two have the same, and none has one that
    is itself an entity of the data.  Given names are held apart so among those of a surname, whatever their gender.
    Those that collide, but for the first, try again with another digest, until none does: only cards and accounts,
    which have a fixed length, could go on, and of those there are far more than entities."""
    given = F.col("kind").startswith("given")
    pool = F.when(given, F.concat(F.lit("given" + SEPARATOR), F.substring_index("norm", SEPARATOR, -1))).otherwise(F.col("kind"))
    own = F.when(given, F.substring_index("norm", SEPARATOR, 1)).otherwise(F.lower("norm"))
    real = checkpoint(entities.select(pool.alias("pool"), own.alias("surrogate")).distinct().withColumn("real", F.lit(True)))
    now = checkpoint(with_surrogates(entities.withColumn("attempt", F.lit(0)), key))
    for attempt in range(1, 8 * ROUNDS):
        pooled = now.withColumn("pool", pool)
        first = pooled.groupBy("pool", "surrogate").agg(F.min(F.struct("attempt", "kind", "norm")).alias("first"))
        judged = pooled.join(first, ["pool", "surrogate"]).join(real, ["pool", "surrogate"], "left")
        again = (F.col("first.kind") != F.col("kind")) | (F.col("first.norm") != F.col("norm")) | F.col("real").isNotNull()
        judged = checkpoint(judged.select("kind", "norm", "attempt", "surrogate", again.alias("again")))
        if judged.where("again").isEmpty():
            return judged.drop("again")
        tried = with_surrogates(judged.where("again").select("kind", "norm", F.lit(attempt).alias("attempt")), key)
        now = checkpoint(judged.where("not again").drop("again").unionByName(tried))
    raise ValueError("some entities have no surrogate of their own")


def parts_of(raw: Column) -> Column:
    """The entities in a match, as (kind, norm, gender, part, at): a name has a surname and up to three given names or initials,
    each with its word of the text and that word's number; gender is that of the name's titles, if one tells it.  Titles
    and particles are no entities."""
    full = raw.rlike(rf"^{_OWN}(?: (?:{_OWN}|{_INITIAL}))?(?: (?:{'|'.join(PARTICLES)})){{0,3}} {_OWN}$")
    kind = _alternatives({k: p for k, p in KINDS.items() if k != "password"}, raw, F.when(full, "name").otherwise("password"))
    digits = F.regexp_replace(raw, r"\D", "")
    norm = F.when(kind == "phone", F.concat(F.when(raw.startswith("+"), "+").otherwise(""), digits)).when(kind == "card", digits).when(kind == "iban", F.lower(F.replace(raw, F.lit(" "))))
    norm = norm.when(kind == "password", raw).otherwise(F.lower(raw))
    words = F.transform(F.split(raw, " "), lambda w, i: F.struct(w.alias("word"), i.alias("at")))
    bare = lambda w: F.regexp_replace(w["word"], r"\.$", "")
    title = lambda w: bare(w).isin([t for titles in TITLES.values() for t in titles])
    gendered = lambda g: F.exists(words, lambda w: bare(w).isin(TITLES[g]))
    gender = F.when(gendered("f"), "f").when(gendered("m"), "m").otherwise("")
    last = F.element_at(words, -1)
    entity = lambda kind, norm, gender, part, at: F.struct(kind.alias("kind"), norm.alias("norm"), gender.alias("gender"), part.alias("part"), at.cast("int").alias("at"))

    def given(w: Column) -> Column:
        kind = F.when(w["word"].rlike(f"^{_INITIAL}$"), "initial").otherwise("given")
        return entity(kind, F.concat_ws(SEPARATOR, F.lower(w["word"]), F.lower(last["word"])), gender, w["word"], w["at"])

    before = F.filter(F.slice(words, 1, F.size(words) - 1), lambda w: ~title(w) & ~w["word"].isin(PARTICLES))
    names = F.concat(F.transform(before, given), F.array(entity(F.lit("surname"), F.lower(last["word"]), F.lit(""), last["word"], last["at"])))
    return F.when(kind == "name", names).otherwise(F.array(entity(kind, norm, F.lit(""), raw, F.lit(-1))))


def full_name(raw: Column) -> Column:
    """Of a name, titled or not, its words but for titles, in lower case; null if that is a surname alone."""
    names = F.filter(F.split(raw, " "), lambda w: ~F.regexp_replace(w, r"\.$", "").isin([t for titles in TITLES.values() for t in titles]))
    return F.when(F.size(names) > 1, F.lower(F.array_join(names, " ")))


def untitled(docs: DataFrame, raws: DataFrame) -> DataFrame | None:
    """(hash, raws): the texts of ``docs`` that name a person of ``raws`` (raw) in full without a title, and how; None if nobody
    is named in full.  A name is first given name and surname, or all that came with the title."""
    named = raws.where(F.col("raw").rlike(f"^(?:{KINDS['name']})$")).select(full_name(F.col("raw")).alias("full")).where("full is not null")
    words = F.split("full", " ")
    short = F.concat_ws(" ", F.get(words, F.lit(0)), F.array_join(F.filter(F.slice(words, 2, F.size(words) - 1), lambda w, i: w.isin(PARTICLES) | (i == F.size(words) - 2)), " "))
    named = named.select(F.explode(F.array_distinct(F.array("full", short))).alias("full")).where(~F.col("full").rlike(r"^\p{L}\. ")).distinct()
    named = checkpoint(named)
    if named.isEmpty():
        return None
    text = F.coalesce("text", F.lit(""))
    every = F.array_distinct(F.concat(*[F.regexp_extract_all(text, F.lit(p), F.lit(1)) for p in UNTITLED]))
    each = docs.select(F.xxhash64("text").alias("hash"), F.explode(every).alias("raw")).withColumn("full", F.lower("raw"))
    each = each.join(F.broadcast(named) if fits(named, F.length("full")) else named, "full", "left_semi").select("hash", "raw").distinct()
    return checkpoint(each.groupBy("hash").agg(F.collect_set("raw").alias("raws")))


def with_gender(raws: DataFrame) -> DataFrame:
    """``raws`` (kind, norm, gender and others) with the kind of given names made "given:script:gender".

    A person's gender is that of the titles that come with the full name anywhere.  With titles of both, these are two
    persons, and mentions without one are of the man; without any, a hash of the name chooses."""
    given = F.col("kind") == "given"
    known = raws.where(given).groupBy("norm").agg(F.max(F.col("gender") == "m").alias("_m"), F.max(F.col("gender") == "f").alias("_f"))
    known = known.withColumnRenamed("norm", "_norm")
    chosen = F.when(F.col("gender") != "", F.col("gender")).when(F.col("_m"), "m").when(F.col("_f"), "f").when(_number(F.sha2("norm", 256), 0, 2) == 0, "f").otherwise("m")
    out = raws.join(known, given & (F.col("norm") == F.col("_norm")), "left")
    kind = F.when(given, F.concat_ws(":", "kind", script_of(F.col("norm")), chosen)).otherwise(F.col("kind"))
    return out.withColumn("kind", kind).drop("_m", "_f", "_norm", "gender")


def poured(part: Column, made: Column) -> Column:
    """A surrogate in the format of the text: where that has a letter or digit comes the surrogate's next one, in the
    same case; separators stay; what is left over comes last."""

    def one(state: Column, c: Column) -> Column:
        own = F.substring(made, state["at"], F.lit(1))
        own = F.when((c != F.lower(c)) | (part == F.upper(part)), F.upper(own)).otherwise(own)
        solid = c.rlike(r"^[\p{L}\p{N}+]$")
        return F.struct(F.concat(state["out"], F.when(solid, own).otherwise(c)).alias("out"), (state["at"] + F.when(solid, 1).otherwise(0)).alias("at"))

    start = F.struct(F.lit("").alias("out"), F.lit(1).alias("at"))
    return F.aggregate(F.split(part, ""), start, one, lambda s: F.concat(s["out"], F.substring(made, s["at"], F.length(made))))


def replacements(found: DataFrame, key: str) -> DataFrame:
    """(raw, replacement) of every different match in ``found`` (raw) that is personal data."""
    raws = found.select("raw").distinct().select("raw", F.explode(parts_of(F.col("raw"))).alias("x")).select("raw", "x.*")
    raws = checkpoint(raws.where(is_valid(F.col("kind"), F.col("norm"))))
    initials = raws.where("kind = 'initial'")
    raws = checkpoint(with_gender(raws.where("kind <> 'initial'")))
    made = assign(raws.select("kind", "norm").distinct(), key).select("kind", "norm", "surrogate")
    kind, part, new = F.col("kind"), F.col("part"), F.col("surrogate")
    named = (kind == "surname") | kind.startswith("given")
    capital = F.array_join(F.transform(F.split(new, "-"), lambda x: F.initcap(x)), "-")
    cased = F.when((part == F.upper("part")) & (F.length("part") > 1), F.upper(new)).when(named, capital).otherwise(new)
    new = F.when(named | kind.isin("email", "ip"), cased).otherwise(poured(part, F.regexp_replace(new, r"[^\p{L}\p{N}+]", "")))
    words = raws.join(made, ["kind", "norm"]).select("raw", "at", new.alias("new"))
    # letters are few: initials of different people may become the same
    words = words.union(initials.select("raw", "at", F.upper(_like(F.col("part"), _digest(key, F.col("kind"), F.col("norm"))))))
    pairs = words.groupBy("raw").agg(F.map_from_entries(F.collect_list(F.struct("at", "new"))).alias("x"))
    replaced = F.array_join(F.transform(F.split("raw", " "), lambda w, i: F.coalesce(F.try_element_at("x", i), w)), " ")
    return pairs.select("raw", F.coalesce(F.try_element_at("x", F.lit(-1)), replaced).alias("replacement"))


def pseudonymise(docs: DataFrame, key: str = "orbiteer") -> DataFrame:
    """``docs`` (text and any others) with the personal data in text replaced, and n_replaced.

    ``KINDS`` says what is found: mail and network addresses, phone, card, account and social security numbers, access
    keys, passwords, and names after titles: given names, initials, particles and a surname, of which titles and particles
    stay.  A person who is named in full after a title anywhere is found by that full name without one, too (``untitled``); a
    surname alone isn't.  Numbers of cards and accounts need right check digits (``is_valid``), and
    their surrogates have right ones.  An entity's surrogate is made from a digest of ``key``, its kind and its normal
    form, so it is the same wherever and however written (coreference), and looks like it: digits for digits, letters
    of the same script and case, octets of as many digits, given names of the person's gender (``with_gender``).
    Surrogates that collide with each other or with real entities are made anew, so different entities stay different:
    surnames do, and given names within a surname, hence full names; the same given name with another surname is another
    entity.

    Only texts with a match are joined to their replacements; all others pass as they are.  What is found at a place is
    the first kind that fits.  A null text stays null, an empty one empty, and a long one is replaced whole.  Rows are
    told apart by their text, so ones that repeat a doc_id, or have none, are each replaced.  An empty table gives no
    row.  Columns n_replaced, _hash, _private, _named, _found, _names, _first and _new
    are replaced."""
    docs = docs.drop("n_replaced", "_hash", "_private", "_named", "_found", "_names", "_first", "_new")
    text = F.coalesce(F.col("text"), F.lit(""))
    every = F.when(text.rlike(SCREEN), F.regexp_extract_all(text, F.lit(ANY), F.lit(0))).otherwise(F.array().cast("array<string>"))
    found = docs.select(F.xxhash64("text").alias("hash"), F.array_distinct(every).alias("raws")).where(F.size("raws") > 0)
    found = checkpoint(found.distinct())
    each = found.select("hash", F.explode("raws").alias("raw"))
    mentions = untitled(docs, each.select("raw").distinct())
    if mentions is not None and not mentions.isEmpty():
        each = each.union(mentions.select("hash", F.explode("raws").alias("raw"))).distinct()
    new = checkpoint(replacements(each, key))
    each = each.join(F.broadcast(new) if fits(new, F.length("raw") + F.length("replacement")) else new, "raw")
    maps = each.groupBy("hash").agg(F.collect_set(F.struct("raw", "replacement")).alias("pairs"))
    maps = checkpoint(maps.select(F.col("hash").alias("_hash"), F.map_from_entries("pairs").alias("_private")))
    size = F.aggregate(F.map_entries("_private"), F.lit(0), lambda a, x: a + 32 + F.length(x["key"]) + F.length(x["value"]))
    docs = docs.withColumn("_hash", F.xxhash64("text"))
    if fits(maps, size):
        return _replaced(docs.join(F.broadcast(maps), "_hash", "left"), docs, every)
    named = mentions.select(F.col("hash").alias("_hash")) if mentions is not None else None
    matched = F.coalesce(F.size(every) > 0, F.lit(False))
    if named is not None and not named.isEmpty():  # texts that are matched by a name without a title only
        known = F.broadcast(named) if fits(named, F.lit(8)) else named
        docs = docs.join(known.withColumn("_named", F.lit(True)), "_hash", "left")
        matched = matched | F.col("_named").isNotNull()
    clean = docs.where(~matched).drop("_named").withColumn("_private", F.lit(None).cast(maps.schema["_private"].dataType))
    private = docs.where(matched).drop("_named").join(maps, "_hash", "left")
    docs = docs.drop("_named")
    return _replaced(private, docs, every).union(_replaced(clean, docs, every))


def _replaced(joined: DataFrame, docs: DataFrame, every: Column) -> DataFrame:
    private, found = F.col("_private"), F.col("_found")
    joined = joined.withColumn("_found", every)
    # full names without a title come last, the longest first: none of the surrogates is one
    names = F.filter(F.map_keys(private), lambda k: k.rlike(rf"^{_OWN} ") & ~F.array_contains(found, k))
    joined = joined.withColumn("_names", F.array_sort(names, lambda a, b: F.length(b) - F.length(a)))
    pieces = F.split(F.col("text"), ANY, -1)
    made = F.transform(found, lambda m: F.coalesce(private[m], m))
    new = F.array_join(F.zip_with(pieces, F.concat(made, F.array(F.lit(""))), lambda a, b: F.concat(a, b)), "")
    whole = lambda k: F.concat(F.lit(r"(?<![\p{L}\p{N}'’-])"), F.regexp_replace(k, r"\.", r"\\\\."), F.lit(_END))
    some = F.coalesce(F.size("_names"), F.lit(0)) > 0
    joined = joined.withColumn("_first", new)
    named = F.aggregate("_names", F.col("_first"), lambda t, k: F.regexp_replace(t, whole(k), private[k]))
    before = F.aggregate("_names", F.lit(0), lambda n, k: n + F.size(F.split(F.col("_first"), whole(k), F.lit(-1))) - 1)
    known = private.isNotNull() & F.col("text").isNotNull()
    count = F.size(F.filter(found, lambda m: private[m].isNotNull())) + F.when(some, before).otherwise(0)
    joined = joined.withColumns({"_new": F.when(known, F.when(some, named).otherwise(F.col("_first"))).otherwise(F.col("text")), "n_replaced": F.when(known, count).otherwise(0).cast("long")})
    return joined.select(*[F.col("_new").alias(c) if c == "text" else F.col(f"`{c}`") for c in docs.columns if c != "_hash"], "n_replaced")


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudonymise(table(spark, sf_dir, "documents").select("doc_id", "text"))
