"""Operator 4: personal data replaced by keyed surrogates.

Mentions of one entity are told by its canonical form (digits of a number, an address in lower case), so that it gets one
surrogate wherever and however it is written. The surrogate is drawn by a keyed hash of kind, canonical form and a
counter, and keeps what the kind demands: script and case of letters, gender of names, country code of phones, range
of addresses, brand and checksum of cards, country and checksum of account numbers. It is written over the mention,
whose own format stays.

*Collision checks.* Over all distinct entities of the corpus: no two of a kind have one surrogate, and no surrogate is
an entity of the corpus. Those that fail draw again with the next counter until all pass.

Contract. Null and empty texts, and texts without mentions, stay as they are, byte for byte. Repeated rows get equal
results. The map from entities to surrogates depends on key and corpus only. Other columns are kept; ``n_chars``, where
there is one, follows the length. A hint (a digit, an at sign, a form of address) decides natively which rows are searched;
only those are joined with their surrogates, on a hash of the text.
"""

from __future__ import annotations

import hmac
import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from courtside.llm.common import need, shared_folder, slices, staged

MALE = ("Mr", "Herr", "Monsieur", "Señor", "Г-н")
FEMALE = ("Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Señora", "Г-жа")
HINT = r"[\p{Nd}@]|" + "|".join(MALE + FEMALE)
_OCTET = r"(?:25[0-5]|2[0-4]\d|1?\d?\d)"
_DATE = r"\d\d[ ./-]\d\d[ ./-](?:19|20)\d\d(?!\d)|\d\d[./-]\d\d[./-]\d\d \d|\d\d\.\d\d ?- ?\d\d\.\d\d(?![.\d])"
MENTION = re.compile("|".join((
    r"(?P<email>[\w.%+-]*[\w%+-]@[\w-]+(?:\.[\w-]+)+)",
    r"(?P<iban>(?<!\w)[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?!\w))",
    rf"(?P<ip>(?<![\w.]){_OCTET}(?:\.{_OCTET}){{3}}(?![\w]|\.\d))",
    r"(?P<card>(?<![\w.+])\d(?:[ -]?\d){12,18}(?!\w))",
    r"(?P<ssn>(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-]))",
    # With a country code, with a trunk zero (dates and hours ruled out), in groups of three and four, nine digits in any groups.
    r"(?P<phone>(?<!\w)\+\d(?:[ ()./-]{0,2}\d){7,14}(?!\w)"
    rf"|(?<![\w.,/+-])(?!{_DATE})\(?00?[1-9](?:[ ()./-]{{0,2}}\d){{6,13}}(?!\w|[.,]\d)"
    r"|(?<!\w)(?:\+\d{1,3}[ .-]?)?(?:\(\d{1,4}\)[ .-]?|\d{2,4}[ .-])\d{3,4}[ .-]?\d{3,4}(?!\w|,\d\d(?!\d))"
    r"|(?<![\w.,/+-])(?=(?:\d[ .-]?){8}\d(?!\w|[ .,-]\d))[6-9]\d{1,2}(?:[ .-]\d{2,3}){3})",
    rf"(?P<name>\b(?:{'|'.join(MALE + FEMALE)})\b\.?(?: [^\W\d_a-z]\w+){{1,3}})",
)))
# Given names by script and gender.
GIVEN = {
    ("latin", "m"): "Adam Bruno Carl David Emil Felix Georg Hugo Ivan Jonas Karl Leo Marco Nils Oscar Paul Rene Simon Theo Victor".split(),
    ("latin", "f"): "Anna Berta Clara Dora Emma Frida Greta Hanna Ida Julia Klara Lena Maria Nina Olga Paula Rosa Sara Tina Vera".split(),
    ("cyrillic", "m"): "Антон Борис Виктор Глеб Денис Егор Иван Кирилл Лев Максим".split(),
    ("cyrillic", "f"): "Анна Вера Галина Дарья Елена Зоя Инна Ксения Лидия Мария".split(),
}
SYLLABLES = {"latin": "ba be bi bo da de di do ka ke ki ko la le li lo ma me mi mo na ne ni no ra re ri ro sa se si so ta te ti to".split(),
             "cyrillic": "ба бе би бо да де ди до ка ке ки ко ла ле ли ло ма ме ми мо на не ни но ра ре ри ро са се си со та те".split()}
ROUNDS = 64
WIDEN = 8  # draws after which an address or a name gets one part longer


def canonical(kind: str, mention: str) -> str:
    if kind in ("phone", "card", "ssn"):
        return ("+" if mention.startswith("+") else "") + re.sub(r"\D", "", mention)
    if kind == "iban":
        return mention.replace(" ", "")
    if kind == "name":  # a form of address counts by its gender only
        title, names = mention.split(" ", 1)
        return ("Mr. " if title.rstrip(".") in MALE else "Ms. ") + names
    return mention.lower() if kind == "email" else mention


def mentions(text: str | None) -> list[tuple[str, str, int, int]]:
    """(kind, canonical form, start, end) of each, in order."""
    return [(m.lastgroup, canonical(m.lastgroup, m[0]), m.start(), m.end()) for m in MENTION.finditer(text or "")]


class _Stream:
    """Endless keyed numbers for one entity and counter."""

    def __init__(self, key: bytes, *label: str):
        self.key, self.label, self.block, self.pool = key, "\x1f".join(label).encode(), 0, 0
        self.left = 0

    def below(self, n: int) -> int:
        if self.left < 4:
            digest = hmac.digest(self.key, self.label + self.block.to_bytes(4, "big"), "sha256")
            self.pool, self.left, self.block = int.from_bytes(digest, "big"), 28, self.block + 1
        self.pool, value = divmod(self.pool, 1 << 64) if self.left > 8 else (0, self.pool)
        self.left -= 8
        return value % n


def _script(ch: str) -> str:
    return "cyrillic" if "Ѐ" <= ch <= "ӿ" else "latin"


def _like(ch: str, stream: _Stream) -> str:
    """Another character of the same class and script."""
    if ch.isdecimal():
        return str(stream.below(10))
    if not ch.isalpha():
        return ch
    new = chr((0x430 if _script(ch) == "cyrillic" else 0x61) + stream.below(26))
    return new.upper() if ch.isupper() else new


def _luhn(digits: str) -> int:
    return sum(d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d) for i, d in enumerate(map(int, reversed(digits)))) % 10


def _mod97(country: str, body: str) -> int:
    return int("".join(str(int(c, 36)) for c in body + country + "00")) % 97


def surrogate(key: bytes, kind: str, entity: str, counter: int) -> str:
    """The ``counter``-th surrogate of an entity, in canonical form."""
    s = _Stream(key, kind, entity, str(counter))
    if kind == "email":
        local, _, domain = entity.rpartition("@")
        *labels, top = domain.split(".")
        # A domain is an entity of its own: addresses that share one share its surrogate.
        d = _Stream(key, "domain", domain)
        keep = labels[-1] if labels and labels[-1] == "example" else None
        # Where short addresses are all taken, a longer one is free.
        longer = "".join(chr(0x61 + s.below(26)) for _ in range(counter // WIDEN))
        named = ["".join(_like(c, d) for c in label) if label != keep else label for label in labels]
        return "".join(_like(c, s) for c in local) + longer + "@" + ".".join([*named, top])
    if kind == "ip":
        first = int(entity.split(".")[0])
        head = str(first) if first in (10, 127) else str(1 + s.below(223))
        return ".".join([head, *(str(s.below(256)) for _ in range(3))])
    if kind == "ssn":
        return f"{1 + s.below(665):03d}{1 + s.below(99):02d}{1 + s.below(9999):04d}"
    if kind == "phone":
        # Kept: the country code, or trunk zeros with the digit that makes them such, or the range of a nine-digit number.
        code = (2 if entity[1] in "17" else 3) if entity.startswith("+") else len(entity) - len(entity.lstrip("0")) or int(len(entity) == 9)
        rest = len(entity) - code
        return entity[:code] + "".join(str(2 + s.below(8)) if i in (0, rest - 7) else str(s.below(10)) for i in range(rest))
    if kind == "card":
        body = entity[0] + "".join(str(s.below(10)) for _ in entity[1:-1])
        check = (10 - _luhn(body + "0")) % 10
        return body + str(check if _luhn(entity) == 0 else (check + 1 + s.below(9)) % 10)
    if kind == "iban":
        body = "".join(_like(c, s) for c in entity[4:])
        return f"{entity[:2]}{98 - _mod97(entity[:2], body):02d}{body}"
    title, *names = entity.split(" ")
    gender = "m" if title.rstrip(".") in MALE else "f"
    script = _script(names[0][0])
    given = GIVEN[script, gender]
    # A first of several names is a given name; the last, or the only one, is a family name.
    out = [given[s.below(len(given))] for _ in names[:-1]]
    out.append("".join(SYLLABLES[script][s.below(len(SYLLABLES[script]))] for _ in range(3 + s.below(2) + counter // WIDEN)).capitalize())
    return " ".join([title, *out])


def written(kind: str, mention: str, new: str) -> str:
    """The surrogate in the format of the mention."""
    if kind in ("phone", "card", "ssn", "iban"):
        signs = iter(new[new.startswith("+"):] if kind != "iban" else new)
        return "".join(next(signs) if c.isalnum() else c for c in mention)
    if kind == "email":
        if mention.isupper():
            return new.upper()
        return "".join(n.upper() if o.isupper() else n for o, n in zip(mention, new)) if len(mention) == len(new) else new
    if kind == "name":
        return mention.split(" ", 1)[0] + " " + new.split(" ", 1)[1]
    return new


def replaced(text: str, known: dict[tuple[str, str], str]) -> str:
    out, at = [], 0
    for kind, entity, start, end in mentions(text):
        out += [text[at:start], written(kind, text[start:end], known[kind, entity])]
        at = end
    return "".join([*out, text[at:]])


def _find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in (part for whole in batches for part in slices(whole)):
        rows = {(h, m[0], m[1]) for h, text in zip(batch.column("text_hash").to_pylist(), batch.column("text").to_pylist())
                for m in mentions(text)}
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.string()),
                                          pa.array([r[2] for r in rows], pa.string())], names=["text_hash", "kind", "entity"])


def _draw(key: bytes):
    @F.pandas_udf("string")
    def drawn(kind: pd.Series, entity: pd.Series, counter: pd.Series) -> pd.Series:
        return pd.Series([surrogate(key, k, e, int(c)) for k, e, c in zip(kind, entity, counter)], dtype=object)
    return drawn


def surrogates(entities: DataFrame, key: bytes, folder: str) -> DataFrame:
    """(kind, entity, counter, surrogate) for distinct (kind, entity), all distinct and none an entity itself."""
    drawn = _draw(key)
    now = staged(entities.withColumn("counter", F.lit(0)).withColumn("surrogate", drawn("kind", "entity", "counter")),
                 "surrogates_0", folder)
    for number in range(1, ROUNDS):
        taken = now.select("kind", F.col("entity").alias("surrogate"), F.lit(True).alias("real"))
        place = F.row_number().over(Window.partitionBy("kind", "surrogate").orderBy("counter", "entity"))
        judged = now.withColumn("place", place).join(taken, ["kind", "surrogate"], "left")
        judged = judged.withColumn("again", (F.col("place") > 1) | F.col("real").isNotNull())
        if judged.filter("again").isEmpty():
            return now
        counter = F.col("counter") + F.col("again").cast("int")
        after = judged.select("kind", "entity", counter.alias("counter"), F.when(~F.col("again"), F.col("surrogate")).alias("old"))
        after = after.withColumn("surrogate", F.coalesce("old", drawn("kind", "entity", "counter"))).drop("old")
        now = staged(after, f"surrogates_{number}", folder)
    raise RuntimeError(f"surrogates still collide after {ROUNDS} draws")


def _rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in (part for whole in batches for part in slices(whole)):
        texts = [replaced(t, {(k["kind"], k["entity"]): k["surrogate"] for k in known}) if known else t
                 for t, known in zip(batch.column("text").to_pylist(), batch.column("__pii_known").to_pylist())]
        kept = [texts if n == "text" else batch.column(n) for n in batch.schema.names if n != "__pii_known"]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) if isinstance(c, list) else c for c in kept],
                                         names=[n for n in batch.schema.names if n != "__pii_known"])


def pseudonymised(docs: DataFrame, key: bytes) -> DataFrame:
    """``docs`` with all mentions in ``text`` replaced."""
    folder = shared_folder(docs.sparkSession)
    hinted = F.coalesce(F.col("text").rlike(HINT), F.lit(False))
    found = (need(docs, "text").filter(hinted).select(F.xxhash64("text").alias("text_hash"), "text")
             .mapInArrow(_find, "text_hash long, kind string, entity string").distinct())
    found = staged(found, "mentions", folder)
    known = surrogates(found.select("kind", "entity").distinct(), key, folder)
    of_text = (found.join(known, ["kind", "entity"]).groupBy("text_hash")
               .agg(F.collect_list(F.struct("kind", "entity", "surrogate")).alias("__pii_known"))
               .withColumnRenamed("text_hash", "__pii_hash"))
    searched = docs.filter(hinted).withColumn("__pii_hash", F.xxhash64("text")).join(of_text, "__pii_hash", "left")
    size = F.length("text")
    if "n_chars" in docs.columns:
        searched = searched.withColumn("n_chars", F.col("n_chars") - size)
    done = searched.select(*docs.columns, "__pii_known").mapInArrow(_rewrite, docs.schema)
    if "n_chars" in docs.columns:
        done = done.withColumn("n_chars", (F.col("n_chars") + size).cast(docs.schema["n_chars"].dataType))
    return docs.filter(~hinted).unionByName(done)


def query(docs: DataFrame, key: bytes) -> DataFrame:
    return pseudonymised(docs, key).select("doc_id", "text")
