"""Training of the weights of ``pii``: ``python -m lorekeep.llm.pii_train LEXICON.parquet``.

Labelled notes are generated: frames of several languages are filled with invented
names, numbers and addresses in many notations, mixed with technical sentences and
decoys. The weights maximise the conditional likelihood of the labels (forward and
backward sums over the candidate lattice), with a small penalty on their size.
``TRAIN_NOTES`` bounds the labelled sample.
"""

from __future__ import annotations

import json
import random
import sys
from pathlib import Path

from lorekeep.llm.pii import Lexicon, Span, candidates, decode, partition

#: Labelled notes the model is fitted on, and held-out notes it is measured on.
TRAIN_NOTES, TEST_NOTES = 9000, 1500

_MORE_GIVEN = ["Zoé", "Emeka", "Leila", "Tobias", "Marisol", "Jürgen", "Amina", "Ingrid", "Celeste", "Yara", "Rohan", "Will", "Rose", "Anton", "Lucía", "Émile", "Wanda", "Pavel", "Nuria", "Otto"]
_MORE_FAMILY = ["O'Harrow", "D'Ambral", "Corvin-Hale", "Lang-Meister", "Östermark", "Peñalver", "Kowarsk", "Brandquist", "Hallovan", "Merrowick", "Tarnelli", "Vostelli", "MacArden", "Delacruz", "van Hoorn", "de Vallier", "von Strand", "del Marro"]
_TOWNS = ["Oakford", "Nether Wold", "East Marlow", "Saint Albray", "Copper Bay", "Fernwick", "Harrowdale", "Millport", "Brookham", "Tarn Bay", "Lower Finch"]
_TOWNS_DE = ["Nebelstadt", "Altenau", "Grünfeld", "Neustadt an der Lahr", "Oberwald", "Kirchheim am See"]
_TOWNS_FR = ["Montval", "Saint-Aubin-les-Bois", "Valbois", "Pont-d'Arve", "Clairmont", "Bourg-sur-Lie"]
_TOWNS_ES = ["Villanera", "Puerto Alcanor", "Torre del Olmo", "Peñablanca", "San Ferrán"]
_ROADS = ["Maple", "Thorn", "Kestrel", "Halewood", "Larch", "Marlowe", "Copper Beech", "Old Mill", "Ninth", "Wickham", "Juniperus", "Slate"]
_ROAD_KIND = ["Street", "St.", "Road", "Rd.", "Avenue", "Ave", "Lane", "Close", "Court", "Drive", "Way", "Terrace", "Boulevard", "Place"]
_FR = ["rue des Lilas", "avenue du Vieux-Port", "chemin de la Brise", "impasse des Tonneliers", "boulevard Orlan", "place Saint-Roch", "quai de l'Aube", "rue Haute"]
_VERBS = ["Appeler", "Contacter", "Prévenir", "Consulter", "Voir", "Rappeler", "Llamar", "Contactar", "Informar", "Buscar", "Fragen", "Rufen", "Notify", "Remind", "Ping", "Tell", "Inform", "Thank", "Alert", "Visit"]
_DE = ["Am Hohen Tor", "Auf dem Kamp", "Unter den Eichen", "Am Neuen Hafen", "Lindengasse", "Uferallee", "Quellstraße", "Finkenstr.", "Am Alten Markt", "An der Mühle", "Bergweg", "Birkenplatz", "Im Winkel"]
_ES = ["Calle del Olmo", "Camino Viejo", "Plaza de las Velas", "Avda. Peñablanca", "Paseo de la Ribera", "Calle Mayor"]
_IDENT = ["anchor_tracer_lane", "batchProbe36", "queue/batch_slot.proto", "slot.warm_lane", "cache::fold_lane", "shardVertex", "trim_hint", "edge/pack_tombstone.rs"]
_NOISE = [
    "Change {h} makes {i} drop {n} rows.", "Column {i} now takes {n} bytes on the store.", "Replaced {i} by {i} in {i}; it is {n} points better.", "An empty page came up when {i} met {i} over {n}.", "{i} went from {n} ms to {n} minutes after {i}.", "With {n} clients the runner loses an update.",
    "We keep {i} at {n}, and {i} owns it.", "Reverted {h} as {i} needs {i} for a slow scan.", "After a stale read {i} uses {h} and skips {i}.", "{i} may run twice: the cache retries it {n} times.", "THE {i} AND {i} SHARE A LOCK, SEE ABOVE.", "A half-read file and an off-by-two page at {n}.",
]
_TITLE_WORDS = ["Stale", "Retry", "Period", "Done", "Dirty", "Index", "Queue", "Lane", "Fail", "Ready", "Window", "Cache", "Budget", "Ledger", "Read", "Flush", "Signal", "Note", "Level", "Page", "Entry", "Policy", "Token", "Review"]
_DECOYS = [
    "Case {n4}-{n2}-{n4} is closed.", "Release {n4}.{n2}.{n4} works, {n4}.{n2}.{n6} does not.", "timestamp 17{n4}{n6} is in the log", "Listen on 10.0.0.{n1}, port {n4}.", "Span 7f{n4}-{n4}-4e{n2} took long.", "See {n4}.{n3} in the manual.", "Upgrade lib@{n1}.{n2}.{n1} first.", "the @{w} annotation is gone",
    "Lane {n2} is slower than lane {n1}.", "The street map layer is off.", "Use port {n4} or {n4}.", "Hope for the best, plan for the rest.", "Row {n4} {n4} {n4} was skipped.", "Version 10.{n3}.{n4} is out.", "Order {n3}-{n4} and part {n2}-{n3}-{n1} arrived.", "Range 1000-{n4} is free, id {n6} is not.",
    "user@host failed, root@localhost did not", "The {G} {W} lasts {n2} seconds.", "{G} {W} and {G} {W} are flags.", "{G} {W} is a setting.", "Press {G} {W} to go on.", "The {W} {W} and the {W} {W} differ.", "{W} {W} {n2} failed.", "See {G} {W}, then {W} {G}.", "It moved from {G} {W} to {G} {W}.", "Both {G} {W} and {W} {W} fail.", "{G} {W} of {n2}, {G} {W} of {n2}.", "the {G} {W}.",
    "They are named {G} {W} and {G} {W}.", "Choose {G} {W} or {G} {W}.", "Three modes: {W} {W}, {G} {W} and {G} {W}.", "a {G} {W} of {n2}, {W} {W} and {G} {W}.", "{G} {W}, {G} {W}.", "{G} {W} and {G} {W}.", "no {G} {W} and no {G} {W}.", "between {G} {W} and {G} {W}.",
    "The account is DE{n2} {n4} {n4} {n4} {n4} {n2}.", "IBAN GB{n2} WXYZ {n4} {n4} {n4} {n2}", "Batch {n3} {n3} {n3} of the run.", "Offsets {n4} {n4} {n4} are taken.", "counter 4{n4}{n4} went up",
]


class Maker:
    def __init__(self, lexicon: list[tuple[str, str]], seed: int):
        self.r = random.Random(seed)
        self.given = [w for w, p in lexicon if p == "given"]
        self.family = [w for w, p in lexicon if p == "family"]
        plain = [w for w in self.family if len(w) > 7 and " " not in w]
        self.heads, self.tails = [w[:5] for w in plain], [w[-4:] for w in plain]

    def digits(self, n: int) -> str:
        return "".join(self.r.choice("0123456789") for _ in range(n))

    def cased(self, s: str) -> str:
        x = self.r.random()
        return s.lower() if x < 0.1 else s.upper() if x < 0.17 else s

    def name(self) -> str:
        r = self.r
        g = r.choice(self.given if r.random() < 0.75 else _MORE_GIVEN)
        x = r.random()
        f = r.choice(self.family) if x < 0.55 else r.choice(self.heads) + r.choice(self.tails) if x < 0.87 else r.choice(_MORE_FAMILY)
        if r.random() < 0.14:
            g = g[0] + "."
        elif r.random() < 0.12:
            g += f" {r.choice(self.given)}" if r.random() < 0.5 else f" {r.choice('ABEHJLMRS')}."
        return self.cased(f"{f}, {g}" if r.random() < 0.15 else f"{g} {f}")

    def email(self) -> str:
        r = self.r
        g, f = r.choice(self.given).lower(), r.choice(self.family).lower().replace(" ", "")
        g, f = (s.encode("ascii", "ignore").decode() or "kim" for s in (g, f))
        user = r.choice([f"{g}.{f}", f"{f}_{g}", f"{g[0]}{f}", f"{g}{r.randint(1, 99)}", f"{f}+{r.choice(['lane', 'index', 'todo'])}", f"x{f}.dev", f"{g}-{f}"])
        host, tld = r.choice(["example", "mail.tarn", "lab-two", "relay", "team.copper"]), r.choice(["org", "com", "net", "example", "test", "invalid"])
        x = r.random()
        if x < 0.7:
            s = f"{user}@{host}.{tld}"
        elif x < 0.8:
            s = f"{user} [at] {host} [dot] {tld}".replace("[dot]", r.choice(["[dot]", "[dot]"]))
        elif x < 0.88:
            s = f"{user} (at) {host}.{tld}"
        else:
            s = f"{user} at {host.replace('.', ' dot ')} dot {tld}"
        return s.upper() if r.random() < 0.06 else s.title() if r.random() < 0.05 and "@" in s else s

    def phone(self) -> str:
        r, d = self.r, self.digits
        s = r.choice([
            f"({d(3)}) 555-{d(4)}", f"{d(3)}-555-{d(4)}", f"{d(3)}.555.{d(4)}", f"+1 {d(3)} 555 {d(4)}", f"+1{d(10)}", f"07{d(3)} {d(6)}", f"+44 7{d(3)} {d(6)}", f"020 {d(4)} {d(4)}",
            f"0{d(2)}/{d(5)}-{d(3)}", f"+49 {d(2)} {d(5)} {d(3)}", f"01.{d(2)}.{d(2)}.{d(2)}.{d(2)}", f"+33 1 {d(2)} {d(2)} {d(2)} {d(2)}", f"+34 6{d(2)} {d(3)} {d(3)}", f"0{d(1)} {d(2)} {d(2)} {d(2)} {d(2)}", f"{d(3)} 555 {d(4)}", f"+{d(2)}-{d(3)}-{d(7)}",
        ])
        return s + (f" ext. {d(3)}" if r.random() < 0.1 and s[0] in "(123456789" else "")

    def identity(self) -> str:
        r, d = self.r, self.digits
        ni = ["QQ", d(2), d(2), d(2), r.choice("ABCD")]
        return r.choice([f"9{d(2)}-{d(2)}-{d(4)}", f"9{d(2)} {d(2)} {d(4)}", " ".join(ni), "".join(ni), f"X{d(8)}", f"000{d(5)}{r.choice('ABDEFJKLNQRSTVXYZ')}", f"000{d(5)}-{r.choice('ABDEFJKQRSTZ')}", f"0{d(1)} {d(3)} {d(3)} {d(3)}", f"0{d(10)}"])

    def labelled(self) -> tuple[str, str, str]:
        """A number whose kind only its label tells, or that is written as another country does: (label, number, kind)."""
        r, d = self.r, self.digits
        nine = r.choice([f"{d(3)} {d(3)} {d(3)}", d(9)])
        if r.random() < 0.35:
            return r.choice(["phone", "tel", "mobile", "dial", "call", "fax", "téléphone", "Telefon", "teléfono"]), nine, "phone"
        other = r.choice([f"{d(3)}.{d(3)}.{d(3)}-{d(2)}", f"{d(4)} {d(4)} {d(4)}", f"{r.choice('12')} {d(2)} {d(2)} {d(2)} {d(3)} {d(3)}", f"{r.choice('12')} {d(2)} {d(2)} {d(2)} {d(3)} {d(3)} {d(2)}", f"{r.choice('CKLN')}{d(8)}"])
        return r.choice(["passport", "passport number", "SIN", "tax id", "tax number", "national id", "identity number", "CPF", "Aadhaar", "pasaporte", "passeport", "Steuernummer", "NIR"]), r.choice([nine, nine, other]), "identity_number"

    def address(self) -> str:
        r, d = self.r, self.digits
        zip_ = "00" + d(3)
        sep = ",\n" if r.random() < 0.12 else ", "
        x = r.random()
        if x < 0.6:
            s = f"{r.randint(1, 260)}{r.choice(['', '', '', 'a', 'b', 'c'])} {r.choice(_ROADS)} {r.choice(_ROAD_KIND)}"
            if r.random() < 0.25:
                s += f", Apt {r.randint(1, 40)}{r.choice(['', 'A', 'B', 'C'])}"
            if r.random() < 0.88:
                s += f"{sep}{r.choice(_TOWNS)}" + (f" {zip_}" if r.random() < 0.6 else "")
            return s.lower() if r.random() < 0.12 else s
        if x < 0.75:
            return f"{r.randint(1, 260)}{r.choice(['', '', ' bis', ' ter'])} {r.choice(_FR)}{sep}{zip_} {r.choice(_TOWNS_FR)}"
        if x < 0.88:
            return f"{r.choice(_DE)} {r.randint(1, 180)}{sep}{zip_} {r.choice(_TOWNS_DE)}"
        return f"{r.choice(_ES)} {r.randint(1, 250)}{sep}{zip_} {r.choice(_TOWNS_ES)}"

    FRAMES = [
        "Please forward this to {N} at {E}.", "Delivery for \"{N}, {A}\" was late.", "Ansprechpartnerin ist {N}, erreichbar unter {P}.", "Lieferanschrift: {A}.", "They moved to {A} in spring.", "Pick the parcel up at {A} by noon.",
        "Her number {I} leaked into the dump along with {P}.", "Telefon {P}, Ausweis {I}.", "{{\"owner\": \"{N}\", \"cell\": \"{P}\"}}", "Record {I} belongs to {N}.", "On weekends dial {P} first.", "login \"{E}\" was refused, then \"{E}\" was tried",
        "Contactar con {E}, teléfono {P}.", "Approved by Prof. {N}.", "Unsubscribe via mailto:{E} today.", "{N} confirmed by phone ({P}) on Monday.", "Lunch with {N} and {N} near {A} went well.", "Adresse: {A}, Personalnummer {I}.", "Page {N} ({P}) when alerts fire.",
        "POST user={E}&nid={I} came from the old client", "Attendees: {N}; {N}; {N}.", "Appeler {N} au {P} ou écrire <{E}>.", "Pregunte por {N}; pasaporte {I}.", "Maintainer: {N} <{E}>", "{N} takes over next week; ask there.", "bcc {N}; fon:{P}", "Regards,\n{N}\n{A}\n{P}\n",
        "Someone gave {E} as an address.", "The form had {I} in it twice.", "fullname={N}; nid={I}; email={E}", "Adresse de livraison : {A}.", "# FIXME({E}): clean up", "Ask {N} for the key.", "Author: {N}\n", "{V} {N} au {P}.", "{V} {N}; {I}.", "{V} {N} ({P}) soon.", "{V} {N}.", "{V} {N}, <{E}>.", "{V} {N} au {P} ou par lettre.", "Notify {N} now.", "Contacter {N} demain.", "Informar a {N} hoy.", "Tell {N} about it.", "Prévenir {N} avant lundi.", "Remind {N}, then {N}.", "Bitte {N} fragen.", "Llame a {N} y a {N}.", "Ping {N} ({P}).", "Consulter {N} au {P}.", "Preguntar a {N}; tel. {P}.", "Passport {I} expired.", "from {N}: the run failed", "{N} and {N} paired on it.",
        "Call {N}, {P}.", "Anschrift: {A}.", "Ships from {A} after lunch.", "Bring it to {A} tonight.", "Wohnt {A}, seit Mai.", "Lives at {A}; rings twice.", "Domicilio: {A}.", "tel {P}.", "assigned to {N}.", "({N})", "Mr. {N} lives at {A}.", "tax id {I}, phone {P}", "Thanks to {N} for the trace.", "Frau {N} wohnt in der {A}.", "Dirección: {A}; teléfono {P}.", "mail {E}.", "contact: {N} / {E} / {P}.",
        "{N}, {A}.", "{A} to {A}, by van", "Meet {N} at {A} to sign.", "{N} wrote it.", "reported by {N}.", "{P}.", "{N}.", "id: {I}", "{E}, {E}; {E}", "Send {A} a copy before the end of May.", "Numéro {I}, courriel {E}.",
    ]

    LABELLED = ["The {L} was on the form.", "{L}", "Their {L}, as they said.", "He read out the {L}.", "We stored the {L} by mistake.", "({L})", "Wrong {L}; check again."]

    def fill(self, frame: str, at: int, labels: list[tuple[int, int, str]]) -> str:
        makers = {"N": ("name", self.name), "E": ("email", self.email), "P": ("phone", self.phone), "I": ("identity_number", self.identity), "A": ("street_address", self.address)}
        out, i = "", 0
        while i < len(frame):
            if frame[i : i + 2] in ("{{", "}}"):
                out, i = out + frame[i], i + 2
            elif frame[i : i + 3] == "{V}":
                out, i = out + self.r.choice(_VERBS), i + 3
            elif frame[i : i + 3] == "{L}":
                label, s, kind = self.labelled()
                out += label + self.r.choice([" ", ": ", " is ", " no. "])
                labels.append((at + len(out), at + len(out) + len(s), kind))
                out, i = out + s, i + 3
            elif frame[i] == "{" and frame[i + 1] in makers:
                kind, make = makers[frame[i + 1]]
                s = make()
                labels.append((at + len(out), at + len(out) + len(s.rstrip(".")), kind))
                # a name or street that ends in a full stop before a sentence end keeps one stop
                out, i = out + (s.rstrip(".") if frame[i + 3 : i + 4] == "." else s), i + 3
            else:
                out, i = out + frame[i], i + 1
        return out

    def note(self) -> tuple[str, list[tuple[int, int, str]]]:
        r = self.r
        text, labels = "", []
        for _ in range(r.randint(2, 5)):
            x = r.random()
            if x < 0.46:
                s = self.fill(r.choice(self.FRAMES), len(text), labels)
            elif x < 0.5:
                s = self.fill(r.choice(self.LABELLED), len(text), labels)
            elif x < 0.75:
                s = r.choice(_DECOYS)
                for k in ("n1", "n2", "n3", "n4", "n6"):
                    while f"{{{k}}}" in s:
                        s = s.replace(f"{{{k}}}", r.choice("123456789") + self.digits(int(k[1]) - 1), 1)
                s = s.replace("{w}", r.choice(["lane", "probe"]))
                while "{G}" in s or "{W}" in s:
                    s = s.replace("{G}", r.choice(["Mark", "Will", "Grace", "Hope", "Rose", "May", r.choice(self.given)]), 1).replace("{W}", r.choice(_TITLE_WORDS), 1)
            else:
                s = r.choice(_NOISE)
                while "{" in s:
                    s = s.replace("{h}", f"{r.getrandbits(28):07x}", 1) if "{h}" in s else s.replace("{i}", r.choice(_IDENT), 1) if "{i}" in s else s.replace("{n}", str(r.randint(2, 9999)), 1)
                if r.random() < 0.15:
                    s = s.upper() if r.random() < 0.5 else s.lower()
            text += s + r.choice([" ", " ", " ", "\n"])
        return text.rstrip(" "), labels


def train(lexicon_rows: list[tuple[str, str]], notes: int = TRAIN_NOTES, rounds: int = 4, rate: float = 0.15, seed: int = 11) -> dict[str, float]:
    # part of the lexicon is hidden, so that unlisted names are met in training
    r = random.Random(seed)
    shown = Lexicon([x for x in lexicon_rows if r.random() < 0.75])
    m = Maker(lexicon_rows, seed)
    data = []
    for _ in range(notes):
        text, labels = m.note()
        spans = candidates(text, shown)
        gold = set(labels)
        if spans:
            data.append((spans, [(s.start, s.end, s.kind) in gold for s in spans]))
    w: dict[str, float] = {}
    size: dict[str, float] = {}
    for _ in range(rounds):
        r.shuffle(data)
        for spans, truth in data:
            _, p = partition(spans, w)
            grad: dict[str, float] = {}
            for s, t, q in zip(spans, truth, p):
                g = t - q
                if abs(g) > 1e-4:
                    for f in s.features:
                        grad[f] = grad.get(f, 0.0) + g
            for f, g in grad.items():
                g -= 1e-4 * w.get(f, 0.0)
                size[f] = size.get(f, 1e-6) + g * g
                w[f] = w.get(f, 0.0) + rate * g / size[f] ** 0.5
    return {f: round(x, 3) for f, x in w.items() if abs(x) >= 0.02}


def measure(lexicon_rows: list[tuple[str, str]], w: dict[str, float], notes: int = TEST_NOTES, seed: int = 99) -> dict[str, tuple[float, float]]:
    """Precision and recall per kind on held-out notes."""
    r = random.Random(seed)
    lex, m = Lexicon([x for x in lexicon_rows if r.random() < 0.75]), Maker(lexicon_rows, seed)
    hit, said, real = {}, {}, {}
    for _ in range(notes):
        text, labels = m.note()
        found: list[Span] = decode(candidates(text, lex), w)
        got = {(s.start, s.end, s.kind) for s in found}
        for k in {x[2] for x in labels} | {x[2] for x in got}:
            a, b = {x for x in got if x[2] == k}, {x for x in labels if x[2] == k}
            hit[k], said[k], real[k] = hit.get(k, 0) + len(a & b), said.get(k, 0) + len(a), real.get(k, 0) + len(b)
    return {k: (hit[k] / max(said[k], 1), hit[k] / max(real[k], 1)) for k in sorted(real)}


if __name__ == "__main__":
    import pyarrow.parquet as pq

    t = pq.read_table(sys.argv[1]).to_pydict()
    rows = [(w, p) for w, p in zip(t["word"], t["part"]) if w]
    fitted = train(rows)
    Path(__file__).with_name("pii_weights.json").write_text(json.dumps(fitted, indent=0, sort_keys=True, ensure_ascii=False))
    print(len(fitted), measure(rows, fitted))
