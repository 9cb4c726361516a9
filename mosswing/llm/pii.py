"""Surrogates for personal data: keyed, of the same type, gender, script and format; distinct and coreferent.

Native: DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, stored, table

HOT = 1_000_000  # occurrences from which on an entity is joined by broadcast: at most one a million occurrences is

MALE_TITLES = "Mr|Herr|Monsieur|Señor|Sr|Господин|Κύριος"
FEMALE_TITLES = "Mrs|Ms|Miss|Frau|Madame|Mme|Señora|Sra|Госпожа|Κυρία"
OTHER_TITLES = "Dr|Prof"
MALE = {
    "latin": "James John Robert Michael William David Thomas Peter Hans Karl Pierre Jean Louis Carlos Juan Luis".split(),
    "cyrillic": "Иван Пётр Алексей Дмитрий Сергей Николай Андрей Михаил".split(),
    "greek": "Γιώργος Νίκος Κώστας Δημήτρης Γιάννης Πέτρος".split(),
}
FEMALE = {
    "latin": "Mary Anna Linda Susan Karen Laura Emma Julia Greta Heidi Marie Claire Sophie Carmen Lucía Elena".split(),
    "cyrillic": "Мария Анна Елена Ольга Наталья Ирина Светлана Татьяна".split(),
    "greek": "Μαρία Ελένη Κατερίνα Σοφία Άννα Ειρήνη".split(),
}
#: Further first names by which a person without a title is found; surrogates are not made of them.
KNOWN_MALE = (
    "Aaron Adam Alan Albert Alejandro Alexander Alfred Andreas Andrew Anthony Antoine Antonio Arthur Benjamin Bernard Brandon Brian Bruce Carl Charles Christian "
    "Christopher Claude Daniel Dennis Diego Donald Douglas Edward Emil Emmanuel Eric Ethan Felix Fernando Francis Francisco Frank Friedrich Gabriel Gary George Georg "
    "Gerald Gregory Harold Harry Heinrich Henri Henry Hugo Ian Jack Jacob Jacques Jakob Jason Javier Jeffrey Jeremy Johann Johannes Jonathan Jorge Joseph Joshua Julien "
    "Justin Keith Kenneth Kevin Klaus Larry Lars Laurent Lawrence Leo Leon Liam Lucas Lukas Manuel Marc Marcel Marco Mark Markus Martin Mason Matthew Matthias Max "
    "Miguel Mohammed Nathan Nicholas Nicolas Noah Oliver Olivier Oscar Otto Pablo Patrick Paul Pedro Philip Philippe Rafael Ralph Raymond Richard Roger Ronald Roy "
    "Russell Ryan Samuel Scott Sebastian Sergio Simon Stefan Stephen Steven Terry Theodore Thierry Timothy Tobias Victor Vincent Walter Werner Wolfgang Zachary"
).split()
KNOWN_FEMALE = (
    "Abigail Adele Alexandra Alice Alicia Amanda Amelia Amy Ana Andrea Angela Anke Anne Annette Anja Ashley Barbara Beatriz Betty Birgit Brenda Brigitte Camille "
    "Carla Carol Caroline Catherine Cecilia Charlotte Chloe Christina Christine Clara Claudia Cristina Cynthia Deborah Denise Diana Donna Dorothy Elisabeth Elizabeth "
    "Ella Emily Erika Eva Evelyn Florence Frances Gabriela Gloria Grace Hannah Heather Helen Helga Ines Ingrid Isabel Isabella Jacqueline Jane Janet Janine Jean "
    "Jennifer Jessica Joan Johanna Josephine Judith Juliette Karin Katharina Katherine Kathleen Katrin Kelly Kimberly Lena Lisa Louise Lucie Luisa Madison Manon "
    "Margaret Margarita Maria Marina Marion Marta Martina Megan Melissa Michelle Mia Monica Monika Nancy Natalia Natalie Nathalie Nicole Nina Olivia Pamela Patricia "
    "Paula Petra Pilar Rachel Rebecca Renate Rosa Rosemary Ruth Sabine Samantha Sandra Sara Sarah Sharon Silvia Simone Stefanie Stephanie Sylvie Teresa Theresa "
    "Ursula Valerie Vanessa Veronica Victoria Virginia Yvonne"
).split()
SYLLABLES = {
    "latin": "ba be bo da de do fa fe ga go ha he ka ke ko la le lo ma me mo na ne no pa pe ra re ro sa se so ta te to va ve wa zo".split(),
    "cyrillic": "ба бе бо ва ве да де до за ка ко ла ле ло ма ме мо на не но па по ра ре ро са се со та те то ха че ша".split(),
    "greek": "βα γα γε δα δε κα κε κο λα λε λο μα με μο να νε νο πα πε πο ρα ρε ρο σα σε σο τα τε το φα φε χα".split(),
}
_TITLES = f"{MALE_TITLES}|{FEMALE_TITLES}|{OTHER_TITLES}"
_NAME = r"\p{Lu}\p{Ll}+"


def _by_letter(names: list[str]) -> str:
    """An alternation of names, decided on their first letter."""
    letters = sorted({n[0] for n in names})
    return "|".join(f"{c}(?:" + "|".join(sorted({n[1:] for n in names if n[0] == c}, key=lambda x: (-len(x), x))) + ")" for c in letters)


_FIRST = _by_letter([n for names in (MALE, FEMALE) for group in names.values() for n in group] + KNOWN_MALE + KNOWN_FEMALE)

_KEYWORD = r"(?i:token|secret|password|passwd|api[_-]?key) ?"
_VALUE = r"[=:] ?[\"']?"

#: In this order where two could begin at one place. Each fails on its first character nearly everywhere.
KINDS = {
    "secret": rf"[=:](?<={_KEYWORD}[=:]) ?[\"']?[A-Za-z0-9_+/-]{{12,}}",
    "email": r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}_%+-][\p{L}\p{N}._%+-]*+@[\p{L}\p{N}-]+(?:\.[\p{L}\p{N}-]+)+",
    "ip": r"(?<![\p{L}\p{N}.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?!\d|\.\d)",
    "ssn": r"(?<![\p{L}\p{N}-])\d{3}-\d{2}-\d{4}(?![\p{N}-])",
    "card": r"(?<![\p{L}\p{N}])\d(?:[ -]?\d){12,18}(?!\p{N})",
    "phone": r"(?<![\p{L}\p{N}+])(?:(?:\+\d{1,3}[ .-]?)?(?:\(\d{2,4}\)[ .-]?\d{3,4}[ .-]?\d{3,4}|\d{3}-\d{3}-\d{4})|\+\d{1,3}[ .-]?\d{2,4}(?:[ .-]?\d{2,4}){1,4})(?!\p{N})",
    "key": r"(?<![A-Za-z0-9_])(?:AKIA[0-9A-Z]{16}|ghp_[A-Za-z0-9]{30,}|sk-[A-Za-z0-9]{20,})",
    "iban": r"(?<![\p{L}\p{N}])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![\p{L}\p{N}])",
    "person": rf"(?<!\p{{L}})(?:(?:{_TITLES})\.? {_NAME}(?: {_NAME})?|(?:{_FIRST}) {_NAME})(?!\p{{L}})",
}


def _any_of(*kinds: str) -> str:
    return "(?:" + "|".join(KINDS[k] for k in kinds) + ")"


PATTERN = "|".join([
    KINDS["secret"], KINDS["email"], r"(?=[0-9+(])" + _any_of("ip", "ssn", "card", "phone"), r"(?=[Ags])" + _any_of("key"), r"(?=\p{Lu})" + _any_of("iban", "person")])


def _kind(raw: Column) -> Column:
    bare = raw.rlike(f"^{_NAME}(?: {_NAME})?$")  # a name that the document has with a title or first name elsewhere
    out = F.when(bare, "person").otherwise("secret")
    for kind in [k for k in KINDS if k != "secret"][::-1]:
        out = F.when(raw.rlike(f"^(?:{KINDS[kind]})$"), kind).otherwise(out)
    return out


def _script(raw: Column) -> Column:
    return F.when(raw.rlike(r"\p{IsCyrillic}"), "cyrillic").when(raw.rlike(r"\p{IsGreek}"), "greek").otherwise("latin")


def _gender(raw: Column) -> Column:
    title = F.regexp_extract(raw, rf"^({_TITLES})\.? ", 1)
    first = F.element_at(F.split(F.regexp_replace(raw, rf"^(?:{_TITLES})\.? ", ""), " "), 1)
    men, women = (F.array(*[F.lit(n) for n in sum(who.values(), more)]) for who, more in ((MALE, KNOWN_MALE), (FEMALE, KNOWN_FEMALE)))
    return (
        F.when(title.isin(MALE_TITLES.split("|")), "m").when(title.isin(FEMALE_TITLES.split("|")), "f")
        .when(F.array_contains(men, first), "m").when(F.array_contains(women, first), "f").otherwise("u")
    )


def _given(raw: Column) -> Column:
    """A person's first name; empty if only the last one is written."""
    return F.regexp_extract(F.regexp_replace(raw, rf"^(?:{_TITLES})\.? ", ""), r"^(\p{L}+) ", 1)


def _canonical(kind: Column, raw: Column) -> Column:
    """What all spellings of one entity share: digits of a number, the lower case of an address, a person's last name."""
    return (
        F.when(kind.isin("phone", "card", "ssn"), F.regexp_replace(raw, r"[^0-9]", ""))
        .when(kind == "iban", F.regexp_replace(raw, " ", ""))
        .when(kind == "email", F.lower(raw))
        .when(kind == "person", F.lower(F.element_at(F.split(raw, " "), -1)))
        .when(kind == "secret", F.regexp_replace(raw, f"^{_VALUE}", ""))
        .otherwise(raw)
    )


def _byte(digest: Column, i: Column) -> Column:
    """The i-th of a digest's 64 bytes, over and over."""
    return F.conv(F.substr(digest, F.pmod(i, F.lit(64)) * 2 + 1, F.lit(2)), 16, 10).cast("int")


def _pick(digest: Column, i: Column, options: list[str] | str) -> Column:
    return F.element_at(F.array(*map(F.lit, options)), F.pmod(_byte(digest, i), F.lit(len(options))) + 1)


def _masked(value: Column, digest: Column, fixed: Column) -> Column:
    """value with each letter and digit after the first `fixed` characters replaced by one of its class."""
    hexes = value.rlike("^[0-9a-fA-F]+$")

    def one(c: Column, i: Column) -> Column:
        new = (
            F.when(i < fixed, c)
            .when(c.rlike("[0-9]"), _pick(digest, i, "0123456789"))
            .when(c.rlike("[a-z]"), F.when(hexes, _pick(digest, i, "abcdef")).otherwise(_pick(digest, i, "abcdefghijklmnopqrstuvwxyz")))
            .when(c.rlike("[A-Z]"), F.when(hexes, _pick(digest, i, "ABCDEF")).otherwise(_pick(digest, i, "ABCDEFGHIJKLMNOPQRSTUVWXYZ")))
            .when(c.rlike(r"\p{IsCyrillic}"), _pick(digest, i, "абвгдежзиклмнопрстуфхцчшэюя"))
            .when(c.rlike(r"\p{IsGreek}"), _pick(digest, i, "αβγδεζηθικλμνξοπρστυφχψω"))
            .when(c.rlike(r"\p{L}"), _pick(digest, i, "abcdefghijklmnopqrstuvwxyz"))
        )
        return F.coalesce(new, c)

    return F.array_join(F.transform(F.split(value, ""), one), "")


def _luhn_sum(digits: Column) -> Column:
    """Of the digits before the check digit."""
    chars = F.reverse(F.split(digits, ""))
    doubled = F.transform(chars, lambda c, i: F.when(i % 2 == 0, c.cast("int") * 2 - F.when(c.cast("int") > 4, 9).otherwise(0)).otherwise(c.cast("int")))
    return F.aggregate(doubled, F.lit(0), lambda a, x: a + x)


def _luhn_ended(digits: Column) -> Column:
    body = F.substr(digits, F.lit(1), F.length(digits) - 1)
    return F.concat(body, F.pmod(10 - F.pmod(_luhn_sum(body), F.lit(10)), F.lit(10)).cast("string"))


def _surrogate(key: str) -> Column:
    """Of a row with kind, canon, script, gender, attempt and country (how many digits of a number stay)."""
    kind, canon = F.col("kind"), F.col("canon")
    digest = F.sha2(F.concat_ws("|", F.lit(key), kind, canon, F.col("attempt").cast("string")), 512)
    domain = F.element_at(F.split(canon, "@"), -1)
    host, end = F.regexp_extract(domain, r"^(.*)\.([^.]*)$", 1), F.regexp_extract(domain, r"^(.*)\.([^.]*)$", 2)
    site = F.sha2(F.concat_ws("|", F.lit(key), F.lit("domain"), domain), 512)  # one site keeps one surrogate
    email = F.concat(_masked(F.element_at(F.split(canon, "@"), 1), digest, F.lit(0)), F.lit("@"), _masked(host, site, F.lit(0)), F.lit("."), end)
    octets = [F.pmod(_byte(digest, F.lit(i)), F.lit(223 if i == 0 else 254)) + 1 for i in range(4)]
    ip = F.concat_ws(".", *[F.when(o == 127, 128).otherwise(o).cast("string") for o in octets])
    number = _masked(canon, digest, F.col("country"))
    body = F.substr(canon, F.lit(1), F.length(canon) - 1)
    is_luhn = F.pmod(_luhn_sum(body) + F.substr(canon, F.length(canon), F.lit(1)).cast("int"), F.lit(10)) == 0
    name = F.lit(None).cast("string")
    for script, syllables in SYLLABLES.items():
        built = F.initcap(F.concat(*[_pick(digest, F.lit(i), syllables) for i in range(4)]))
        name = F.when(F.col("script") == script, built).otherwise(name)
    given = F.lit(None).cast("string")
    for script, syllables in SYLLABLES.items():
        for gender, names in (("m", MALE[script]), ("f", FEMALE[script]), ("u", MALE[script] + FEMALE[script])):
            longer = F.when(F.col("attempt") > 0, F.concat(*[_pick(digest, F.lit(i), syllables) for i in (1, 2, 3)])).otherwise("")
            given = F.when((F.col("script") == script) & (F.col("gender") == gender), F.concat(_pick(digest, F.lit(0), names), longer)).otherwise(given)
    return (
        F.when(kind == "email", email).when(kind == "ip", ip)
        .when(kind == "card", F.when(is_luhn, _luhn_ended(number)).otherwise(number))
        .when(kind == "person", name).when(kind.startswith("given "), given)
        .otherwise(number)
    )


def _written(key: str) -> Column:
    """The surrogate in the format of this occurrence (columns kind, raw, canon, script, surrogate, given_new)."""
    kind, raw, new = F.col("kind"), F.col("raw"), F.col("surrogate")
    place = lambda i: F.length(F.regexp_replace(F.substr(raw, F.lit(1), i + 1), "[^0-9]", ""))
    number = F.array_join(F.transform(F.split(raw, ""), lambda c, i: F.when(c.rlike("[0-9]"), F.substr(new, place(i), F.lit(1))).otherwise(c)), "")
    # a surrogate that is longer, because its format had no free one left, keeps its further digits
    number = F.concat(number, F.substr(new, F.length(F.regexp_replace(raw, "[^0-9]", "")) + 1, F.length(new)))
    compact = lambda i: F.length(F.regexp_replace(F.substr(raw, F.lit(1), i + 1), " ", ""))
    iban = F.array_join(F.transform(F.split(raw, ""), lambda c, i: F.when(c == " ", c).otherwise(F.substr(new, compact(i), F.lit(1)))), "")
    iban = F.concat(iban, F.substr(new, F.length(F.regexp_replace(raw, " ", "")) + 1, F.length(new)))
    title = F.regexp_extract(raw, rf"^((?:{_TITLES})\.? )", 1)
    first = _given(raw)
    person = F.concat(title, F.when(first == "", "").otherwise(F.concat(F.col("given_new"), F.lit(" "))), new)
    return (
        F.when(kind.isin("phone", "card", "ssn"), number).when(kind == "iban", iban).when(kind == "person", person)
        .when(kind == "secret", F.concat(F.regexp_extract(raw, f"^{_VALUE}", 0), new))
        .when((kind == "email") & (F.upper(raw) == raw), F.upper(new)).otherwise(new)
    )


def surrogates(entities: DataFrame, key: str) -> DataFrame:
    """kind, canon, surrogate: distinct for distinct entities of a kind, and no entity of the corpus itself.

    entities has one row per kind and canon. Whoever's surrogate another has already, or is itself an entity, tries the
    next keyed digest; the least canon keeps a shared one.
    """
    if "gender" not in entities.columns:
        entities = entities.withColumn("gender", F.lit("u"))
    todo = cut(entities.withColumn("attempt", F.lit(0)))
    while True:
        tried = todo.withColumn("surrogate", _surrogate(key))
        tried = tried.withColumn("same", F.when((F.col("kind") == "person") | F.col("kind").startswith("given "), F.lower("surrogate")).otherwise(F.col("surrogate")))
        own = entities.select("kind", F.col("canon").alias("same"), F.lit(True).alias("real"))
        nth = F.row_number().over(Window.partitionBy("kind", "surrogate").orderBy("attempt", "canon"))
        judged = tried.join(own, ["kind", "same"], "left").withColumn("bad", (nth > 1) | F.col("real").isNotNull())
        judged = cut(judged.select(*entities.columns, "attempt", "surrogate", "bad"))
        # an entity whose space of surrogates is used up would try for ever; a suffix of its digest ends that
        if judged.where(F.col("bad") & (F.col("attempt") < 40)).isEmpty():
            digest = F.substr(F.sha2(F.concat_ws("|", F.lit(key), F.col("kind"), F.col("canon")), 256), F.lit(1), F.lit(16))
            digits, letters = F.translate(digest, "abcdef", "975310"), F.translate(digest, "0123456789", "ghijklmnop")
            suffix = F.when(F.col("kind").isin("phone", "card", "ssn", "iban"), digits).when(F.col("kind").isin("ip", "email"), F.concat(F.lit("."), letters)).otherwise(letters)
            return judged.select("kind", "canon", F.when(F.col("bad"), F.concat("surrogate", suffix)).otherwise(F.col("surrogate")).alias("surrogate"))
        todo = judged.select(*entities.columns, (F.col("attempt") + F.col("bad").cast("int")).alias("attempt"))


def _full(raw: Column) -> Column:
    """First and last name of a person that is written with both; else empty."""
    return F.when(raw.rlike(f"^(?:{KINDS['person']})$"), F.regexp_extract(raw, rf"^(?:(?:{_TITLES})\.? )?({_NAME} {_NAME})$", 1)).otherwise("")


def _last(raw: Column) -> Column:
    return F.when(raw.rlike(f"^(?:{KINDS['person']})$"), F.regexp_extract(raw, rf"({_NAME})$", 1)).otherwise("")


def _one_of(names: Column) -> Column:
    return F.array_join(F.array_distinct(F.filter(names, lambda x: x != "")), "|")


def replace_entities(docs: DataFrame, key: str = "public-demo-key") -> DataFrame:
    """docs with every entity of KINDS replaced in text, n_chars (if there) to match, and n_entities and kinds added.

    One entity has one surrogate in all documents and spellings; distinct entities have distinct ones. A person is a
    last name with a first one: last names are mapped one to one, first names one to one within a last name, and none
    to a name that the corpus has there. In a document that has a person, the same full name without its title, and
    the same last name within a sentence, are found as well.

    Null texts stay null, empty ones empty, with 0 entities; repeated rows stay, each for itself. Columns n_entities
    and kinds of the input are replaced, other ones kept. An empty table gives an empty result.
    """
    names = [c for c in docs.columns if c not in ("n_entities", "kinds")]
    docs = docs.select(*names)
    has = F.coalesce(F.col("text").rlike(PATTERN), F.lit(False))
    first = F.regexp_extract_all("text", F.lit(PATTERN), 0)
    found = docs.where(has).withColumns({"_pii_id": F.monotonically_increasing_id(), "_pii_raw": first})
    full, last = _one_of(F.transform("_pii_raw", _full)), _one_of(F.transform("_pii_raw", _last))
    again = F.when(full != "", F.concat(F.lit(r"(?<!\p{L})(?:"), full, F.lit(r")(?!\p{L})|"))).otherwise("")
    again = F.concat(again, F.when(last != "", F.concat(F.lit(r"(?<=\p{Ll}[,;]? )(?:"), last, F.lit(r")(?!\p{L})|"))).otherwise(""))
    found = found.withColumn("_pii_again", again)
    pattern = F.concat("_pii_again", F.lit(PATTERN))
    found = found.withColumn("_pii_raw", F.when(F.col("_pii_again") == "", F.col("_pii_raw")).otherwise(F.regexp_extract_all("text", pattern, F.lit(0))))
    found = stored(found, "entities")
    each = found.select("_pii_id", F.posexplode("_pii_raw").alias("i", "raw")).withColumn("kind", _kind(F.col("raw")))
    each = each.withColumns({"canon": _canonical(F.col("kind"), F.col("raw")), "script": _script(F.col("raw")), "gender": _gender(F.col("raw"))})
    given = F.lower(_given(F.col("raw")))
    each = cut(each.withColumn("given", F.when((F.col("kind") == "person") & (given != ""), given)))
    country = F.when(F.col("kind") == "phone", F.length(F.regexp_extract("raw", r"^\+(\d{1,3})[ .(-]", 1))).when(F.col("kind") == "card", 1).when(F.col("kind") == "iban", 2).otherwise(0)
    entities = cut(each.groupBy("kind", "canon").agg(F.min("script").alias("script"), F.min(country).alias("country"), F.lit("u").alias("gender"), F.count("*").alias("times")))
    # first names are told apart within a last name
    named = each.where("given is not null").select(F.concat(F.lit("given "), "canon").alias("kind"), F.col("given").alias("canon"), "script", "gender")
    named = named.groupBy("kind", "canon").agg(F.min("script").alias("script"), F.lit(0).alias("country"), F.min("gender").alias("gender"))
    all_mapped = cut(surrogates(cut(entities.drop("times").unionByName(named)), key))
    new_given = all_mapped.where(F.col("kind").startswith("given ")).select(F.expr("substr(kind, 7)").alias("canon"), F.col("canon").alias("given"), F.col("surrogate").alias("given_new"))
    mapped = all_mapped.where(~F.col("kind").startswith("given "))
    # an entity may be in a third of all rows: those meet their surrogate by broadcast, the rest by a shuffle
    hot = cut(entities.where(F.col("times") >= HOT).select("kind", "canon"))
    few = F.broadcast(mapped.join(hot, ["kind", "canon"], "left_semi"))
    plain = each.join(F.broadcast(hot), ["kind", "canon"], "left_anti").join(mapped, ["kind", "canon"])
    met = plain.unionByName(each.join(few, ["kind", "canon"])) if not hot.isEmpty() else each.join(mapped, ["kind", "canon"])
    met = met.join(new_given, ["canon", "given"], "left").withColumn("given_new", F.when(F.col("kind") == "person", F.col("given_new")))
    written = met.select("_pii_id", "i", "kind", _written(key).alias("new"))
    per_doc = written.groupBy("_pii_id").agg(F.array_sort(F.collect_list(F.struct("i", "new"))).alias("_pii_new"), F.array_join(F.array_sort(F.collect_set("kind")), ",").alias("_pii_kinds"))
    between = F.when(F.col("_pii_again") == "", F.split("text", PATTERN, -1)).otherwise(F.split(F.col("text"), pattern, F.lit(-1)))
    woven = F.array_join(F.zip_with(between, F.transform("_pii_new", lambda x: x["new"]), lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")
    replaced = found.join(per_doc, "_pii_id").withColumns({"text": woven, "n_entities": F.size("_pii_raw"), "kinds": F.col("_pii_kinds")})
    if "n_chars" in names:
        replaced = replaced.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    rest = docs.where(~has).select(*names, F.lit(0).alias("n_entities"), F.lit("").alias("kinds"))
    return rest.unionByName(replaced.select(*names, "n_entities", "kinds"))


def op7_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replace_entities(table(spark, sf_dir, "documents").select("doc_id", "text"))
