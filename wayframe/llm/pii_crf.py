"""Personal data in texts: fixed patterns, and a linear-chain conditional random field over word shapes that adds spans.

The field tags the words of each line. A word's features are its shape, counts of digits and marks, and whether it is one of
a few context words; the words before and after count with weights of their own. It is trained here, from a small labelled
table, by gradient steps on the exact likelihood, and decoded by Viterbi over many lines at once in numpy.
Tagged words without the marks around them become spans of the kinds `crf_*`, if they pass the check of their kind and touch no
span of the patterns: numbers without a plus, addresses spelled with (at) and dot, cards and hosts in other separators.

Null and empty texts have no spans. Texts of any length are read whole, about a million characters of words at a time, or one text.
Repeated rows are separate rows, an empty table gives an empty one, and only doc_id and text are read, so other columns cannot clash.
"""

from __future__ import annotations

import ipaddress
import random
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from . import common

BASE = ("email", "ip", "card", "phone")
TAGS = ("O", *(f"{x}-{k}" for k in BASE for x in "BI"))
KINDS = (*BASE, *(f"crf_{k}" for k in BASE))
CONTEXT = frozenset(
    "account at (at) address adresse amex appelez appeler call calling card carte cell charge code contact correo correspond courriel date dot (dot) e-mail ecrivez email en escriba fax from "
    "geheim host hotline ip ipv4 ipv6 isbn karte kreditkarte mail mastercard mobil mobile móvil node number nummer numéro no order page pay phone ping port portable reach ring room rufnummer ruf "
    "server serveur servidor ssh tarjeta tel telefon telephone teléfono to total tél tél. unter version visa von write www year".split()
)
#: Possessive runs: a run that fails is not tried again from each of its digits.
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
WORDS = re.compile(r"[^\x20\x09-\x0D]+")
NOT_DIGIT = re.compile(r"[^0-9]")
EDGE = "\"'.,;:!?[]{}<>#$%&*|=/"


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2]))
    return (total + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])) % 10 == 0


def emails(text: str) -> list[tuple[str, int, int]]:
    """Leftmost matches, found from each @: its local part reaches back to a character of another kind or the last match."""
    found, end, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            found.append(("email", start, m.end()))
            end = m.end()
        at = text.find("@", max(at + 1, end))
    return found


def patterns(text: str) -> list[tuple[str, int, int]]:
    """Spans of the fixed patterns."""
    found = emails(text)
    found += [("ip", *m.span()) for m in IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m[0].split("."))]
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 12 and 12 <= len(d := NOT_DIGIT.sub("", m[0])) <= 19 and luhn(d):
            found.append(("card", *m.span()))
    found += [("phone", *m.span()) for m in PHONE.finditer(text) if 9 <= len(NOT_DIGIT.sub("", m[0])) <= 15]
    return found


#: The labelled table: lines in which braces hold a kind and its words.
LABELLED = """
call {phone (555) 123-4567} after six
you can reach us at {phone 555-867-5309} on weekdays
office phone: {phone 212.555.0187}, ask for Dana
tel {phone 030 1234567} or come by
Telefon {phone 030/4471 2290} von 9 bis 17 Uhr
Rufnummer: {phone 0049 89 1234 5678}
appelez le {phone 01 42 68 53 00} avant midi
tél. {phone 06.12.34.56.78} le soir
teléfono {phone 91 123 45 67} de lunes a viernes
móvil {phone 612 345 678} gracias
her cell is {phone (415) 555 2671} I think
fax {phone (020) 7946-0958} only for orders
ring {phone 020 7946 0018} and wait
text me on {phone 07700 900123} please
my number is {phone 617-555-0142}.
phone {phone 1-800-555-0199} toll free
mobile {phone 0151 23456789} immer erreichbar
contact: {phone 555 0123 456} ext 12
Ruf {phone (0221) 987654} an
call me {phone 9876543210} tonight
dial {phone 001 212 555 0100} from abroad
numéro {phone 04-91-55-12-34} à Marseille
hotline {phone 0800 330 1000} free
{phone (303) 555-0136} is the front desk
{phone 646-555-0171} or {phone 646-555-0172}
write to {email jo.smith (at) mail.org} soon
mail {email anna_k [at] example.com} for the file
email {email dev.team at example dot org} with logs
contact {email sales (at) shop (dot) example (dot) com} today
{email kim.lee [at] uni [dot] edu} sent this
schreibe an {email max.muster (at) firma.de} bitte
courriel {email luc.petit at poste dot fr} merci
correo: {email maria99 (at) correo.es}
reach {email info [at] museum.org} or come by
e-mail {email webmaster(at)site.net} about errors
please write {email help[at]desk.example.com} instead
my address is {email tom at home dot net} since May
{email a.b.c (at) example.net} and {email d_e (at) example.net}
an {email buero [at] kanzlei [dot] de} wenden
écrivez à {email contact (at) ville (dot) fr} vite
escriba a {email ventas at tienda dot com} hoy
ask {email rosa-lin (at) lab.io} for access
from {email noreply at service dot com} yesterday
card {card 4111.1111.1111.1111} expires soon
charge {card 4000/0566/5566/5556} please
visa {card 4242_4242_4242_4242} on file
pay with {card 5555 . 5555 . 5555 . 4444} now
Kreditkarte {card 4012.8888.8888.1881} gesperrt
carte {card 5105/1051/0510/5100} refusée
tarjeta {card 4917.6100.0000.0000} caducada
mastercard {card 5200.8282.8282.8210} is mine
amex {card 3782.822463.10005} worked
the card was {card 6011.1111.1111.1117}, he said
number: {card 3056/9309/0259/04}
account card {card 4222_2222_2222_2} old one
Karte {card 4000.0025.0000.3155} verloren
host {ip 192[.]168[.]1[.]20} was down
server {ip 10-0-0-17} rebooted
ping {ip 172 . 16 . 4 . 9} failed
from {ip fe80::1ff:fe23:4567:890a} at night
ssh to {ip 2001:db8::8a2e:370:7334} works
ip {ip 203[.]0[.]113[.]7} blocked
Server {ip 198-51-100-23} antwortet nicht
serveur {ip 2001:db8:0:1::15} en panne
node {ip 10[.]11[.]12[.]13} joined
servidor {ip 192 . 0 . 2 . 44} caído
ipv6 {ip 2a02:26f0:6c00::210:ba} resolved
address {ip fd12:3456:789a:1::1} assigned
host {ip 192(.)0(.)2(.)1} seen twice
the meeting is on 2024-01-31 at 10:30 in room 214
version 10.4.12.7 was released in 2019
order 100200300 shipped on 03/04/2021
total 1,234.56 with tax 98.70
ISBN 978-3-16-148410-0 is the second edition
page 12 of 340
he was born on 12.05.1987 in Kiel
look at example dot structures in the book
we met at noon. They left at 12
arrived at example.com and read the news
the dot at the end is red
code 4f2a9c01d7e84b33 expired
ratio 16:9 at 1920 x 1080
from 10 to 20 dollars
at 5 dot 5 percent
chapter 3.2.1.4 explains it
call him at once
call number QA76.73 on shelf 12
tel quel est le mot
card games at home
the server at the bar was kind
10 000 000 people live there
1 234 567 890 rows were read
5-7-9-11 are odd
years 1999 2000 2001 2002 were wet
0.5 0.25 0.125 0.0625
time 12:34:56 elapsed
mac 00:1b:44:11:3a:b7 is filtered
id 550e8400-e29b-41d4-a716-446655440000 was lost
room (214) 3-17 upstairs
win 3-2 and 5-4 at home
lot 2021/04/17 batch 0007
price: $1299.00, was $1,499.00
§ 12.3 and 14.7 apply
phone calls cost 10 cents
email is faster than mail
write at least 500 words
kilometer 120 to 155 closed
https://example.org/path/2020/01 was moved
@dana said that at 9
temperature -12.5 to 3.0
Zeile 4711 in Datei 12
le 14 juillet 1789 à Paris
el 12 de octubre de 1492
tracking 1Z 999 AA1 01 2345 6784
account 000123456789 closed
numbers 12 345 and 67 890
v2.10.3-rc1 at 3f2c1d
home | about us | contact | news | terms
login | register | search | mail | help
Startseite | Impressum | Kontakt | Karte
accueil | plan | courriel | liens
buy now !! $$$ best *** price %%% only &&& today ###
*** win *** win *** big ***
name = value # of the server = fast
* first * second * third
score 21 - 18 in 2010
"""
MARKED = re.compile(r"\{(\w+) ([^}]*)\}")
DIGIT = re.compile("[0-9]")


def labelled_table(lines: list[str], draws: int = 4, seed: int = 7) -> list[tuple[list[str], list[str]]]:
    """Words and tags of labelled lines; each line also with its digits drawn anew, and with a mark after its last word, `draws` times."""
    r, table = random.Random(seed), []
    for line in lines:
        for draw in range(draws + 1):
            words: list[str] = []
            tags: list[str] = []
            for k, part in enumerate(MARKED.split(line)):
                found = part.split() if k % 3 != 1 else []
                kind = MARKED.split(line)[k - 1] if k % 3 == 2 else ""
                if k % 3 == 0 and words and part[:1] not in ("", " "):  # a mark that follows a brace belongs to the word before
                    words[-1] += found[0]
                    found = found[1:]
                tags += [f"{'B' if i == 0 else 'I'}-{kind}" if kind else "O" for i in range(len(found))]
                words += found
            if draw:
                words = [DIGIT.sub(lambda _: r.choice("0123456789"), w) for w in words]
                words[-1] += r.choice(["", ".", ",", "!!", "***", "###"])
            table.append((words, tags))
    return table


def table_lines() -> list[str]:
    return [x for x in LABELLED.split("\n") if x]


SHAPES = str.maketrans({**{c: "9" for c in "0123456789"}, **{chr(c): "x" for c in range(97, 123)}, **{chr(c): "X" for c in range(65, 91)}})
RUNS = re.compile(r"(.)\1+", re.S)
OTHER = re.compile(r"[^\x00-\x7F]+")


def shape_of(core: str) -> str:
    shape = core.translate(SHAPES)
    return RUNS.sub(r"\1", shape if shape.isascii() else OTHER.sub("x", shape))


def named(core: str, shape: str) -> tuple[str, ...]:
    """Names of the features of a word without the marks around it, of its whole length."""
    n = len(core) - len(core.translate(NO_DIGITS))
    size = len(core)
    low = core.lower()
    found = (
        "shape " + (shape if len(shape) <= 16 else "long"),
        f"digits {n if n < 5 else 5 if n < 7 else 7 if n < 12 else 12 if n < 20 else 20}",
        f"part {0 if not size else 4 * n // size}", f"@ {core.count('@') + core.count('(at)') + core.count('[at]')}", f"dots {min(core.count('.'), 4)}", f"colons {min(core.count(':'), 4)}", "+" if core[:1] == "+" else "(" if core[:1] == "(" else "none", f"size {min(size, 4)}",
    )
    return (*found, "word " + low) if low in CONTEXT else found


NO_DIGITS = {ord(c): None for c in "0123456789"}


def features(word: str, known: dict[str, tuple[str, ...]] | None = None) -> tuple[str, ...]:
    """Features of a word. known: those of words of letters by their shape, which alone decides unless the word is a context word."""
    core = word.strip(EDGE)
    shape = shape_of(core)
    if known is None or not core.isalpha() or core.lower() in CONTEXT:
        return named(core, shape)
    if (found := known.get(shape)) is None:
        found = known[shape] = named(core, shape)
    return found


class Field:
    """Weights of the field: own, prev and next hold a row of tag weights per feature; step, the weights between tags."""

    def __init__(self, table: list[tuple[list[str], list[str]]], rounds: int = 80, rate: float = 0.2, shrink: float = 1e-3):
        names = sorted({f for words, _ in table for w in words for f in features(w)})
        self.index = {f: i for i, f in enumerate(names)}
        n, t = len(names), len(TAGS)
        longest = max(len(words) for words, _ in table)
        seen = np.zeros((len(table), longest + 2, n))  # a blank word before and after
        gold = np.zeros((len(table), longest), dtype=np.int64)
        size = np.array([len(words) for words, _ in table])
        for i, (words, tags) in enumerate(table):
            for j, (w, tag) in enumerate(zip(words, tags)):
                seen[i, j + 1, [self.index[f] for f in features(w)]] = 1
                gold[i, j] = TAGS.index(tag)
        x = np.concatenate([seen[:, 1:-1], seen[:, :-2], seen[:, 2:]], axis=2).reshape(-1, 3 * n)
        mask = np.arange(longest) < size[:, None]
        hot = np.eye(t)[gold] * mask[..., None]
        both = mask[:, 1:] & mask[:, :-1]
        steps = np.einsum("ijk,ijl->kl", hot[:, :-1] * both[..., None], hot[:, 1:])
        w, step = np.zeros((3 * n, t)), np.zeros((t, t))
        memory = [[np.zeros_like(a), np.zeros_like(a)] for a in (w, step)]
        for k in range(1, rounds + 1):
            mean, pairs = self._expected((x @ w).reshape(len(table), longest, t), step, mask)
            grads = x.T @ (mean - hot).reshape(-1, t) / len(table) + shrink * w, (pairs - steps) / len(table) + shrink * step
            for value, grad, (m, v) in zip((w, step), grads, memory):
                m += 0.1 * (grad - m)
                v += 0.01 * (grad * grad - v)
                value -= rate * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.99**k)) + 1e-8)
        self.own, self.prev, self.next = (w[i * n : (i + 1) * n].astype(np.float32) for i in range(3))
        self.step = step.astype(np.float32)

    @staticmethod
    def _expected(score: np.ndarray, step: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Probabilities of the tags, and expected counts of tag pairs, by the forward-backward recursions."""
        total = lambda a, axis: (m := a.max(axis, keepdims=True)).squeeze(axis) + np.log(np.exp(a - m).sum(axis))
        n = score.shape[1]
        forward, backward = np.empty_like(score), np.zeros_like(score)
        forward[:, 0] = score[:, 0]
        for j in range(1, n):
            forward[:, j] = total(forward[:, j - 1, :, None] + step, 1) + score[:, j]
        for j in range(n - 2, -1, -1):
            new = total(step + (score[:, j + 1] + backward[:, j + 1])[:, None, :], 2)
            backward[:, j] = np.where(mask[:, j + 1, None], new, 0)
        z = total(np.take_along_axis(forward, (mask.sum(1) - 1)[:, None, None], 1)[:, 0], 1)
        mean = np.exp(forward + backward - z[:, None, None]) * mask[..., None]
        pairs = np.zeros_like(step)
        for j in range(1, n):
            p = np.exp(forward[:, j - 1, :, None] + step + (score[:, j] + backward[:, j])[:, None, :] - z[:, None, None])
            pairs += (p * mask[:, j, None, None]).sum(0)
        return mean, pairs

    def rows(self, found: list[tuple[str, ...]]) -> np.ndarray:
        """The three rows of tag weights of each tuple of features: of the word itself, before and after another word."""
        at = [[self.index[f] for f in fs if f in self.index] for fs in found]
        size = np.array([len(a) for a in at])
        flat = np.array([i for a in at for i in a], dtype=np.int64)
        out = np.zeros((len(found), 3, len(TAGS)), dtype=np.float32)
        if len(flat):
            held = np.flatnonzero(size)
            starts = np.r_[0, np.cumsum(size[held])[:-1]]
            for k, weights in enumerate((self.own, self.prev, self.next)):
                out[held, k] = np.add.reduceat(weights[flat], starts, axis=0)
        return out

    def viterbi(self, score: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Best tags of sequences that lie one after another in score; size: their lengths."""
        order = np.argsort(-size, kind="stable")
        start = (np.cumsum(size) - size)[order]
        size = size[order]
        tags = np.zeros(len(score), dtype=np.int8)
        if not len(score):
            return tags
        back = np.zeros((len(score), len(TAGS)), dtype=np.int8)
        live = np.searchsorted(-size, -np.arange(int(size[0])), side="left")  # sequences longer than j
        best = score[start[: live[0]]] if live[0] else score[:0]
        ends = np.zeros(len(size), dtype=np.int64)
        if live[0]:
            last = best.copy()
            for j in range(1, int(size[0])):
                k = live[j]
                at = start[:k] + j
                ways = last[:k, :, None] + self.step
                come = ways.argmax(1)
                back[at] = come
                last[:k] = np.take_along_axis(ways, come[:, None, :], 1)[:, 0] + score[at]
            ends[: live[0]] = last.argmax(1)
            now = ends.copy()
            for j in range(int(size[0]) - 1, -1, -1):
                k = live[j]
                at = start[:k] + j
                tags[at] = now[:k]
                now[:k] = back[at, now[:k]]
        return tags


SPELLED_AT, SPELLED_DOT = (re.compile(rf"\s*[(\[]{w}[)\]]\s*|\s+{w}\s+", re.I) for w in ("at", "dot"))
ADDRESS = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}")
IN_CARD, IN_PHONE = re.compile(r"[0-9](?:[0-9]|[\s./_-]+(?=[0-9]))*"), re.compile(r"[(+]?[0-9](?:[0-9]|[\s().\/-]+(?=[0-9(]))*")
DAY = re.compile(r"(?:19|20)\d\d[-./]\d\d?[-./]\d\d?|\d\d?[-./]\d\d?[-./](?:19|20)\d\d")
DOTTED = re.compile(r"([0-9]+)(\s*(?:\[\.\]|\(\.\)|\.|-)\s*)([0-9]+)\2([0-9]+)\2([0-9]+)")


def valid(kind: str, found: str) -> bool:
    """Whether what the field has tagged is of its kind, in any layout.

    A card has 12 to 19 digits that pass Luhn; a phone number 7 to 15 digits and is no date; a host four parts of at most 255 between equal
    separators, or an address of version 6; an e-mail address, once (at) and (dot) are undone, a name, a domain and an ending of letters.
    """
    digits = NOT_DIGIT.sub("", found)
    if kind == "card":
        return 12 <= len(digits) <= 19 and luhn(digits) and IN_CARD.fullmatch(found) is not None
    if kind == "phone":
        return 7 <= len(digits) <= 15 and IN_PHONE.fullmatch(found) is not None and DAY.fullmatch(found) is None
    if kind == "ip":
        if (m := DOTTED.fullmatch(found)) is not None:
            return all(len(m[k]) <= 3 and int(m[k]) <= 255 for k in (1, 3, 4, 5))
        if found.count(":") < 2:
            return False
        try:
            return ipaddress.ip_address(found).version == 6
        except ValueError:
            return False
    return ADDRESS.fullmatch(SPELLED_DOT.sub(".", SPELLED_AT.sub("@", found))) is not None


class Tagger:
    """Tags the words of texts; remembers the weight rows of words it has met, up to a bound."""

    REMEMBERED = 300_000

    def __init__(self, field: Field):
        self.field = field
        self.seen: dict[str, int] = {}  # rows of words
        self.known: dict[str, tuple[str, ...]] = {}
        self.at: dict[tuple[str, ...], int] = {}  # rows of tuples of features
        self.rows = np.zeros((0, 3, len(TAGS)), dtype=np.float32)

    def spans(self, texts: list[str], bulk: int = 1_000_000) -> Iterator[list[tuple[str, int, int]]]:
        """The field's spans of each text; about `bulk` characters are held as words at once."""
        held: list[str] = []
        size = 0
        for i, text in enumerate(texts):
            held.append(text)
            size += len(text)
            if size >= bulk or i == len(texts) - 1:
                yield from self._spans(held)
                held, size = [], 0

    def _spans(self, texts: list[str]) -> Iterator[list[tuple[str, int, int]]]:
        lines = [[WORDS.findall(line) for line in text.split("\n")] for text in texts]
        words = [w for doc in lines for line in doc for w in line]
        if len(self.seen) > self.REMEMBERED or len(self.at) + len(self.known) > self.REMEMBERED:
            self.seen, self.known, self.at, self.rows = {}, {}, {}, self.rows[:0]
        if new := list(set(words).difference(self.seen)):
            found = [features(w, self.known) for w in new]
            if more := list(dict.fromkeys(f for f in found if f not in self.at)):
                self.at.update(zip(more, range(len(self.at), len(self.at) + len(more))))
                self.rows = np.concatenate([self.rows, self.field.rows(more)])
            self.seen.update(zip(new, map(self.at.__getitem__, found)))
        row = np.fromiter(map(self.seen.__getitem__, words), dtype=np.int64, count=len(words))
        size = np.array([len(line) for doc in lines for line in doc], dtype=np.int64)
        score = self.rows[row, 0]
        if len(row):
            starts = np.zeros(len(row) + 1, dtype=bool)
            starts[np.cumsum(size) - size] = True
            inner = np.flatnonzero(~starts[1:-1]) + 1  # words with another before them in their line
            score[inner] += self.rows[row[inner - 1], 1]
            score[inner - 1] += self.rows[row[inner], 2]
        tags = self.field.viterbi(score, size)
        place = 0
        for text, doc in zip(texts, lines):
            n = sum(map(len, doc))
            yield self._found(text, doc, tags[place : place + n]) if tags[place : place + n].any() else []
            place += n

    @staticmethod
    def _found(text: str, doc: list[list[str]], tags: np.ndarray) -> list[tuple[str, int, int]]:
        found, k, offset = [], 0, 0
        for line, raw in zip(doc, text.split("\n")):
            mine = tags[k : k + len(line)]
            if mine.any():
                open_kind, start, end = "", 0, 0
                for m, tag in zip(WORDS.finditer(raw), mine.tolist()):
                    name = TAGS[tag]
                    core = m[0].strip(EDGE)
                    if name == "O" or not core:
                        kind = ""
                    else:
                        kind = name.rpartition("-")[2]
                    left = offset + m.start() + (m[0].find(core) if core else 0)
                    if open_kind and (kind != open_kind or not name.startswith("I-")):
                        found.append((f"crf_{open_kind}", start, end))
                        open_kind = ""
                    if kind:
                        start = start if open_kind else left
                        open_kind, end = kind, left + len(core)
                if open_kind:
                    found.append((f"crf_{open_kind}", start, end))
            k += len(line)
            offset += len(raw) + 1
        return found


@lru_cache(maxsize=1)
def trained() -> Field:
    return Field(labelled_table(table_lines()))


def find_private(docs: DataFrame, field: Field | None = None) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans and n_added of each row of (doc_id, text)."""
    field = field or trained()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tagger = Tagger(field)
        for b in batches:
            texts = [t if isinstance(t, str) else "" for t in b["text"]]
            rows = []
            for text, extra in zip(texts, tagger.spans(texts)):
                base = patterns(text)
                more = [x for x in extra if valid(x[0][4:], text[x[1] : x[2]]) and not any(x[1] < e and s < x[2] for _, s, e in base)]
                rows.append((*[sum(k == kind for k, _, _ in base) for kind in BASE], common.digest(base, KINDS)[1], common.digest(base + more, KINDS)[0], len(more)))
            yield pd.concat([b[["doc_id"]].reset_index(drop=True), pd.DataFrame(rows, columns=["n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_added"])], axis=1)

    kind = docs.schema["doc_id"].dataType.simpleString()
    return common.in_batches(docs.select("doc_id", "text")).mapInPandas(run, f"doc_id {kind}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long")


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_private(common.table(spark, sf_dir, "documents"))
