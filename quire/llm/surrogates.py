"""Replace personal data by keyed surrogates of the same type, format, script and gender.

Names are found by titles, by common first names, and by phrases that introduce one ("my name is", "Dear", "Regards,").
Every entity has a canonical form (digits of a number, lower-case address, name parts), so mentions that differ only in
writing get the same surrogate, within a document and across the corpus. Surrogates come from keyed permutations of all
strings of the same format, so different entities of one format stay different by construction. What a permutation
cannot rule out, that a surrogate is itself an entity of the corpus or that of another format, is checked over all
entities: those in conflict are permuted anew with another tweak until none is left.

Tables at rest hold entities and surrogates sealed with the key (:func:`seal`), never as plain text.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import arrow_udf

from .common import discard, fresh, text_of, written

# Titles by gender, and common first names by gender, in the scripts that are told apart.
TITLES = {
    "f": ("Mrs", "Ms", "Miss", "Frau", "Mme", "Madame", "Señora", "Sra", "Signora", "Lady", "Г-жа", "Κυρία"),
    "m": ("Mr", "Mister", "Herr", "Monsieur", "Señor", "Sr", "Signor", "Sir", "Г-н", "Κύριος"),
    "n": ("Dr", "Prof", "Mx"),
}
FIRST_NAMES = {
    ("latin", "f"): ("Alice", "Amy", "Anna", "Barbara", "Carol", "Clara", "Diana", "Elena", "Emily", "Emma", "Eva", "Grace", "Hannah", "Helen", "Irene", "Jane", "Jennifer", "Jessica", "Julia", "Karen", "Laura", "Linda", "Lisa", "Lucy", "Maria", "Mary", "Nancy", "Nora", "Olivia", "Patricia", "Paula", "Rachel", "Ruth", "Sandra", "Sarah", "Sofia", "Susan"),
    ("latin", "m"): ("Adam", "Albert", "Andrew", "Anthony", "Bruno", "Carl", "Charles", "Daniel", "David", "Edward", "Eric", "Erik", "Frank", "George", "Henry", "James", "John", "Joseph", "Kevin", "Luca", "Mark", "Martin", "Matthew", "Michael", "Oscar", "Patrick", "Paul", "Peter", "Richard", "Robert", "Samuel", "Simon", "Stephen", "Thomas", "Walter", "William"),
    ("cyrillic", "f"): ("Анна", "Вера", "Дарья", "Елена", "Ирина", "Мария", "Нина", "Ольга"),
    ("cyrillic", "m"): ("Алексей", "Борис", "Виктор", "Дмитрий", "Иван", "Николай", "Павел", "Сергей"),
    ("greek", "f"): ("Άννα", "Ελένη", "Ειρήνη", "Μαρία", "Σοφία", "Χριστίνα"),
    ("greek", "m"): ("Ανδρέας", "Γιώργος", "Δημήτρης", "Κώστας", "Νίκος", "Πέτρος"),
}
#: Letter classes: a letter is replaced by one of its own class. Other letters and digits: see :func:`class_of`.
CLASSES = (
    "aeiouy", "bcdfghjklmnpqrstvwxz", "0123456789", "áéíóúàèìòùâêîôûäëïöüåæøãõý", "çñðþ", "ßÿ", "аеёиоуыэюя", "бвгджзйклмнпрстфхцчшщ", "ъь",
    "αεηιουω", "βγδζθκλμνξπρστφχψ", "άέήίόύώ", "ϊϋΐΰ",
)
_CLASS = {c: chars for chars in CLASSES for c in chars}


@cache
def class_of(c: str) -> str:
    """The characters that may stand for ``c``: its class, or the letters (digits) without case or in lower case of its
    128 code points that have the same Unicode category; empty if ``c`` is neither a letter nor a digit."""
    if c in _CLASS:
        return _CLASS[c]
    kind = unicodedata.category(c)
    if kind not in ("Ll", "Lo", "Lm", "Nd"):
        return ""
    plain = lambda x: unicodedata.category(x) == kind and x not in _CLASS and x.lower() == x and len(x.upper()) == 1 and (x.upper().lower() == x)
    own = "".join(filter(plain, map(chr, range(ord(c) & ~127, (ord(c) | 127) + 1))))
    return own if c in own and len(own) > 1 else ""


KINDS = ("email", "card", "ip", "ssn", "phone", "name")
_OCTET = r"(?:25[0-5]|2[0-4]\d|1?\d?\d)"
_ALL_TITLES = "|".join(sorted((re.escape(t) for ts in TITLES.values() for t in ts), key=len, reverse=True))
_ALL_NAMES = "|".join(sorted((n for ns in FIRST_NAMES.values() for n in ns), key=len, reverse=True))
_PART = r"(?:(?:Mc|Mac|[OD]['’])?[A-ZÀ-ÖØ-Þ][a-zß-öø-ÿ]+|[А-ЯЁ][а-яё]+|[Α-ΩΆΈ-Ώ][α-ωά-ώ]+)"
_CAPITAL = rf"{_PART}(?:-{_PART})*"
#: What introduces a name; fixed values.
CUES = ("my name is", "name is", "name:", "Name:", "Dear", "dear", "Regards,", "regards,", "Sincerely,", "sincerely,", "signed by", "Signed by", "Attn:", "Contact:", "contact person:")
_ALL_CUES = "|".join(sorted(map(re.escape, CUES), key=len, reverse=True))
ENTITY = re.compile(
    r"(?P<email>(?<![\w.%+-])[\w.%+-]+@(?:[\w-]+\.)+[^\W\d_]{2,})"
    r"|(?P<card>(?<![0-9A-Za-z])\d{4}(?P<sep>[ -]?)\d{4}(?P=sep)\d{4}(?P=sep)\d{1,7}(?![0-9A-Za-z]))"
    rf"|(?P<ip>(?<![\d.])(?:{_OCTET}\.){{3}}{_OCTET}(?!\d|\.\d))"
    r"|(?P<ssn>(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-]))"
    r"|(?P<phone>(?<![\dA-Za-z])(?:\+\d{1,3}[ .-]?)?(?:\(\d{2,4}\)[ .-]?\d{3,4}[ .-]?\d{3,4}|\d{3}[ .-]\d{3}[ .-]\d{4})(?![\dA-Za-z])|(?<![\dA-Za-z])\+\d{1,3}(?:[ .-]?\d{2,4}){2,4}(?![\dA-Za-z]))"
    rf"|(?P<name>\b(?:(?:{_ALL_TITLES})\b\.?[ ]{_CAPITAL}(?:[ ]{_CAPITAL})?|(?:{_ALL_NAMES})[ ]{_CAPITAL}))"
    rf"|\b(?:{_ALL_CUES})\s(?P<cued>(?:(?:{_ALL_TITLES})\b\.?[ ])?{_CAPITAL}[ ]{_CAPITAL})"
)
#: A text without any of these holds no entity.
HINT = rf"[0-9@]|{_ALL_TITLES}|{_ALL_NAMES}|{_ALL_CUES}"


def permute(x: int, size: int, key: bytes, tweak: str) -> int:
    """A keyed permutation of 0..size-1: a balanced Feistel network over enough bits, walked until it falls inside."""
    if size <= 1:
        return x
    half = max(1, ((size - 1).bit_length() + 1) // 2)
    mask = (1 << half) - 1
    while True:
        a, b = x >> half, x & mask
        for turn in range(8):
            digest = hashlib.blake2b(f"{tweak}|{turn}|{b:x}".encode(), key=key, digest_size=max(8, (half + 7) // 8)).digest() if half <= 512 else hashlib.shake_256(key + f"{tweak}|{turn}|{b:x}".encode()).digest((half + 7) // 8)
            a, b = b, a ^ (int.from_bytes(digest, "big") & mask)
        x = a << half | b
        if x < size:
            return x


def reformat(s: str, key: bytes, tweak: str) -> str:
    """Permute a string among all strings of its format: characters of the same classes at the same places."""
    slots = [(i, own) for i, c in enumerate(s) if (own := class_of(c))]
    number, size = 0, 1
    for i, own in slots:
        number = number * len(own) + own.index(s[i])
        size *= len(own)
    shape = "".join(own[0] if (own := class_of(c)) else c for c in s)
    number = permute(number, size, key, f"{tweak}|{shape}")
    out = list(s)
    for i, own in reversed(slots):
        number, at = divmod(number, len(own))
        out[i] = own[at]
    return "".join(out)


def seal(key: bytes, plain: str) -> bytes:
    """Encrypt with a keyed hash, the same for equal texts: a tag of the text, and the text under the tag's stream."""
    data = plain.encode()
    tag = hashlib.blake2b(data, key=key, digest_size=16, person=b"quire tag").digest()
    stream = hashlib.shake_256(hashlib.blake2b(tag, key=key, person=b"quire stream").digest()).digest(len(data))
    return tag + bytes(a ^ b for a, b in zip(data, stream, strict=True))


def unseal(key: bytes, sealed: bytes) -> str:
    tag, data = sealed[:16], sealed[16:]
    stream = hashlib.shake_256(hashlib.blake2b(tag, key=key, person=b"quire stream").digest()).digest(len(data))
    return bytes(a ^ b for a, b in zip(data, stream, strict=True)).decode()


def recase(s: str, like: str) -> str:
    """Give the letters of ``s`` the case of ``like``, place by place."""
    return "".join(c.upper() if k < len(like) and like[k].isupper() and len(c.upper()) == 1 else c for k, c in enumerate(s))


def luhn(digits: str) -> int:
    """The check digit that makes ``digits`` + check digit valid."""
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (2 if k % 2 == 0 else 1)
        total += d - 9 if d > 9 else d
    return -total % 10


def script_of(word: str) -> str:
    return "cyrillic" if re.search("[А-яЁё]", word) else "greek" if re.search("[Ά-ώ]", word) else "latin"


def name_parts(said: str) -> tuple[str, str, str, str]:
    """Title (with its dot), gender, first name and surname of a mention; a missing part is empty."""
    words = said.split(" ")
    title = words.pop(0) if words[0].rstrip(".") in {t for ts in TITLES.values() for t in ts} else ""
    gender = next((g for g, ts in TITLES.items() if title.rstrip(".") in ts), "n")
    first = words[0] if len(words) > 1 else ""
    known = next((g for (_, g), ns in FIRST_NAMES.items() if first in ns), None)
    return title, known or gender, first, words[-1]


def canonical(kind: str, said: str) -> str:
    """The form that all mentions of an entity share."""
    if kind in ("card", "ssn"):
        return re.sub(r"\D", "", said)
    if kind == "phone":
        digits = re.sub(r"\D", "", said)
        return digits[1:] if len(digits) == 11 and digits[0] == "1" else digits
    if kind == "name":
        _, gender, first, last = name_parts(said)
        return f"{gender}|{first.lower()}|{last.lower()}"
    return said.lower()


#: After so many attempts the format of an e-mail name or surname grows by two letters, that of a number by a digit, and
#: again after as many.
LONGER = 8
_LETTERS = {"latin": "an", "cyrillic": "ан", "greek": "αν"}


def surrogate(kind: str, entity: str, key: bytes, attempt: int = 0) -> str:
    """The canonical form of the surrogate of a canonical entity."""
    tweak, longer = f"{kind}|{attempt}", attempt // LONGER
    if kind == "email":
        local, _, host = entity.rpartition("@")
        labels = host.split(".")
        # the top-level label stays; equal hosts stay equal
        return reformat(local + "an" * longer, key, f"{tweak}|{host}") + "@" + ".".join([*(reformat(x, key, "host") for x in labels[:-1]), labels[-1]])
    if kind == "card":
        body = reformat(entity[:-1] + "0" * longer, key, tweak)
        return body + str((luhn(body) + int(entity[-1]) - luhn(entity[:-1])) % 10)
    if kind == "ip":
        a, b, c, d = map(int, entity.split("."))
        x = permute((a << 24) + (b << 16) + (c << 8) + d, 1 << 32, key, tweak)
        return ".".join(str(x >> s & 255) for s in (24, 16, 8, 0))
    if kind == "name":
        gender, first, last = entity.split("|")
        script = script_of(last)
        pool = [n.lower() for n in FIRST_NAMES[script, gender]] if gender != "n" else []
        new = pool[permute(pool.index(first), len(pool), key, f"first|{script}|{gender}|{attempt}")] if first in pool else reformat(first, key, f"first|{attempt}")
        # a surname's surrogate does not depend on the first name, so short and full mentions agree
        return f"{gender}|{new}|{reformat(last + _LETTERS[script] * longer, key, f'last|{attempt}')}"
    return reformat(entity + "0" * longer, key, tweak)


def written_like(kind: str, said: str, new: str) -> str:
    """A surrogate in the writing of a mention: its separators, case, country prefix and title."""
    if kind in ("card", "ssn", "phone"):
        digits = re.sub(r"\D", "", said)
        fill = iter(digits[: max(0, len(digits) - len(new))] + new)
        return "".join(next(fill) if c.isdigit() else c for c in said) + "".join(fill)
    if kind == "name":
        title, _, first, last = name_parts(said)
        _, new_first, new_last = new.split("|")
        shown = [recase(new_first, first[:1] + new_first[1:].lower())] if first else []
        return " ".join([*([title] if title else []), *shown, recase(new_last, last)])
    return recase(new, said) if kind == "email" else new


def entities(text: str) -> Iterator[tuple[str, int, int, str]]:
    """(kind, start, end, said) of every entity, left to right without overlap."""
    for m in ENTITY.finditer(text):
        kind = next(k for k in (*KINDS, "cued") if m.group(k) is not None)
        yield ("name" if kind == "cued" else kind), m.start(kind), m.end(kind), m.group(kind)


FOUND = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("entity", T.BinaryType()), T.StructField("group", T.BinaryType()), T.StructField("surrogate", T.BinaryType())]))
REPLACED = T.StructType([T.StructField("text", T.StringType()), *[T.StructField(f"n_{k}", T.LongType()) for k in KINDS], T.StructField("spans", T.StringType())])
#: Exceptions (entity and attempt) that may be broadcast; more are joined by shuffle.
EXCEPTIONS = 200_000


def _likely(texts: pa.Array) -> list[bool]:
    return pc.match_substring_regex(texts, HINT).to_pylist()


def group_of(kind: str, entity: str) -> str:
    """What moves together: all names of a surname, else the entity alone."""
    return entity.rpartition("|")[2] if kind == "name" else entity


def _finder(key: bytes):
    from .telephony import to_arrow

    @arrow_udf(FOUND)
    def find(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        kind_ = to_arrow(FOUND)
        for texts in batches:
            out = []
            for i, likely in enumerate(_likely(texts)):
                own = {(k, canonical(k, s)) for k, _, _, s in entities(texts[i].as_py())} if likely else ()
                out.append([{"kind": k, "entity": seal(key, e), "group": seal(key, group_of(k, e)), "surrogate": seal(key, surrogate(k, e, key))} for k, e in sorted(own)])
            yield pa.array(out, kind_)

    return find


def attempts(known: DataFrame, key: bytes, rounds: int = 200) -> DataFrame:
    """Entities whose first surrogate is in conflict, with the number of the attempt that is not: kind, entity, attempt.

    ``known``: distinct kind, entity, group, surrogate, sealed. A surrogate is in conflict if it is an entity of the corpus,
    or if another entity has it; then all but the least entity give way. All names of one surname move together, so short
    and full mentions agree. Formats grow (see ``LONGER``), so they do not run out; only addresses of four numbers
    keep their length, and ``rounds``, which guards against an endless loop, raises should a corpus use these up.
    """

    @arrow_udf(T.BinaryType())
    def again(kind: pa.Array, entity: pa.Array, attempt: pa.Array) -> pa.Array:
        rows = zip(kind.to_pylist(), entity.to_pylist(), attempt.to_pylist(), strict=True)
        return pa.array([seal(key, surrogate(k, unseal(key, e), key, a)) for k, e, a in rows], pa.binary())

    state, before = known.withColumn("attempt", F.lit(0)), None
    taken = known.select("kind", F.col("entity").alias("surrogate")).withColumn("real", F.lit(True))
    for _ in range(rounds):
        least = state.groupBy("kind", "surrogate").agg(F.min("entity").alias("owner"))
        judged = state.join(taken, ["kind", "surrogate"], "left").join(least, ["kind", "surrogate"])
        bad = F.col("real").isNotNull() | (F.col("owner") != F.col("entity"))
        judged = written(judged.select("kind", "entity", "group", "surrogate", "attempt", bad.alias("bad")), "judged")
        if before is not None:
            discard(before)
        before = judged
        if judged.where("bad").isEmpty():
            out = written(judged.where("attempt > 0").select("kind", "entity", "attempt"), "attempts")
            discard(judged)
            return out
        moving = judged.where("bad").select("kind", "group").distinct().withColumn("moves", F.lit(True))
        step = F.col("moves").isNotNull()
        state = judged.join(moving, ["kind", "group"], "left").select("kind", "entity", "group", F.when(step, again("kind", "entity", F.col("attempt") + 1)).otherwise(F.col("surrogate")).alias("surrogate"), (F.col("attempt") + step.cast("int")).alias("attempt"))
    raise RuntimeError(f"surrogates still in conflict after {rounds} rounds")


def replace(docs: DataFrame, key: bytes, text: str = "text") -> DataFrame:
    """All columns of ``docs`` and a struct ``private`` (another name if taken): the new ``text``, the number of entities
    of each kind, and ``spans`` (kind:start:end in the old text, comma-joined, code points).

    Whole texts are read. Null texts give a null text and no entities; rows repeat as in ``docs``; an empty table gives an
    empty table. The same key gives the same surrogates, in any order of rows and for any
    partitioning. Of the tables written, only the sealed exceptions stay, as the result reads them.
    """
    from .telephony import to_arrow

    key = key if len(key) <= 64 else hashlib.sha512(key).digest()
    row, extra, name = fresh(docs, "row_hash", "exceptions", "private")
    keyed = docs.withColumn(row, F.xxhash64(text_of(text)))
    mentions = written(keyed.select(F.col(row), F.explode(_finder(key)(text_of(text))).alias("e")).select(F.col(row).alias("row"), "e.*").distinct(), "mentions")
    known = written(mentions.select("kind", "entity", "group", "surrogate").distinct(), "entities")
    moved = attempts(known, key)
    changes = mentions.join(moved, ["kind", "entity"]).groupBy(F.col("row").alias(row)).agg(F.collect_set(F.struct("kind", "entity", "attempt")).alias(extra))
    changes = written(changes, "exceptions")
    n = changes.agg(F.sum(F.size(extra))).first()[0] or 0
    for t in (mentions, known, moved):
        discard(t)
    if n:
        keyed = keyed.join(F.broadcast(changes) if n <= EXCEPTIONS else changes, row, "left")
    else:
        keyed = keyed.withColumn(extra, F.expr("cast(null as array<struct<kind:string,entity:binary,attempt:int>>)"))
        discard(changes)

    @arrow_udf(REPLACED)
    def rewrite(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        shape = to_arrow(REPLACED)
        for texts, exceptions in batches:
            plain = [f.name for f in shape]
            columns: dict[str, list] = {c: [] for c in plain}
            for i, likely in enumerate(_likely(pc.fill_null(texts, ""))):
                old = texts[i].as_py()
                counts, spans, out, at = dict.fromkeys(KINDS, 0), [], [], 0
                if likely:
                    special = {(x["kind"], unseal(key, x["entity"])): x["attempt"] for x in exceptions[i].as_py() or ()}
                    for k, a, b, said in entities(old):
                        e = canonical(k, said)
                        out += [old[at:a], written_like(k, said, surrogate(k, e, key, special.get((k, e), 0)))]
                        at = b
                        counts[k] += 1
                        spans.append(f"{k}:{a}:{b}")
                columns["text"].append("".join(out) + old[at:] if out else old)
                columns["spans"].append(",".join(spans))
                for k in KINDS:
                    columns[f"n_{k}"].append(counts[k])
            yield pa.StructArray.from_arrays([pa.array(columns[f.name], f.type) for f in shape], fields=list(shape))

    names = [F.col(f"`{c}`") for c in docs.columns]
    return keyed.select(*names, rewrite(F.col(text), F.col(extra)).alias(name))
