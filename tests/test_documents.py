"""Ownership documents against a walk over the parsed tree; topic signals by hand."""

import datetime as dt
import random
import xml.etree.ElementTree as ET

from crosspanel.operators import text as N
from crosspanel.sources.panels import ownership_trades


def trade(rng, kind):
    value = lambda name, v, note="": "" if v is None else f"<{name}><value>{v}</value>{note}</{name}>"
    note = rng.choice(["", '<footnoteId id="F1"/>', '<footnoteId id="F2"/><footnoteId id="F1"/>'])
    coding = rng.choice(["", "<transactionCoding/>", f"<transactionCoding><transactionFormType>4</transactionFormType><transactionCode> {rng.choice('PSM')}</transactionCode></transactionCoding>"])
    amounts = value("transactionShares", rng.choice(["100", "12.5", "x", "", None]), note) + value("transactionPricePerShare", rng.choice(["3.25", "0", "", None, "n/a"])) + value("transactionAcquiredDisposedCode", rng.choice(["A", "D", None]))
    after = rng.choice(["", f"<postTransactionAmounts>{value('sharesOwnedFollowingTransaction', 7)}</postTransactionAmounts>"])
    date = value("transactionDate", rng.choice(["2024-02-29", " 2023-12-01 ", "yesterday", "", None]))
    return f"<{kind}><securityTitle><value>Common</value></securityTitle>{date}{coding}<transactionAmounts>{amounts}</transactionAmounts>{after}</{kind}>"


def document(rng):
    owner = rng.choice(["", "<officerTitle>CFO</officerTitle>", "<isDirector>1</isDirector>", "<isDirector>1</isDirector><officerTitle></officerTitle>"])
    owners = "".join(f"<reportingOwner><reportingOwnerId><rptOwnerName> Name {i} </rptOwnerName></reportingOwnerId><reportingOwnerRelationship>{owner}</reportingOwnerRelationship></reportingOwner>" for i in range(rng.randint(0, 2)))
    tables = "".join(f"<{k}Table>{''.join(trade(rng, f'{k}Transaction') for _ in range(rng.randint(0, 3)))}</{k}Table>" for k in ("nonDerivative", "derivative") if rng.random() < 0.8)
    notes = rng.choice(["", '<footnotes><footnote id="F1">By a Rule 10b5-1 plan</footnote><footnote id="F2">Other &amp; more</footnote></footnotes>'])
    return f'<?xml version="1.0"?><ownershipDocument><issuer><issuerTradingSymbol>T</issuerTradingSymbol></issuer>{owners}{tables}{notes}</ownershipDocument>'


def number(text):
    try:
        return float(text)
    except (TypeError, ValueError):
        return None


def walked(key, xml):
    try:
        root = ET.fromstring(xml)
    except ET.ParseError:
        return [(key, None, None, None, None, None, None, None, None, None, None, "not well-formed")]
    find = lambda e, path: (e.findtext(path) or "").strip() or None if e is not None else None
    owner = root.find("reportingOwner")
    title = find(owner, ".//officerTitle") or ("Director" if find(owner, ".//isDirector") == "1" else None)
    notes = {f.get("id"): f.text for f in root.iter("footnote")}
    out = []
    for kind, derivative in (("nonDerivativeTransaction", False), ("derivativeTransaction", True)):
        for t in root.iter(kind):
            try:
                date = dt.date.fromisoformat(find(t, "transactionDate/value") or "")
            except ValueError:
                continue
            shares, price = number(find(t, ".//transactionShares/value")) or 0.0, number(find(t, ".//transactionPricePerShare/value"))
            own = {f.get("id") for f in t.iter("footnoteId")}
            code, side = find(t, "transactionCoding/transactionCode") or "P", find(t, ".//transactionAcquiredDisposedCode/value") or "A"
            said = tuple(v for k, v in notes.items() if k in own)
            out.append((key, find(owner, ".//rptOwnerName"), title, derivative, date, code, side, shares, price, shares * price if price else None, said, None))
    return out


def test_ownership_documents(spark):
    rng = random.Random(9)
    docs = [document(rng) for _ in range(120)] + ["<ownershipDocument><a></ownershipDocument>", "no xml <", "<ownershipDocument/>"]
    rows = list(enumerate(docs)) + [(900, None), (901, "")]
    out = ownership_trades(spark.createDataFrame(rows, "id int, x string"), ["id"], "x").collect()
    got = sorted(((r.id, r.insider_name, r.insider_title, r.derivative, r.transaction_date, r.transaction_type, r.disposition, r.shares, r.price, r.total_value, None if r.notes is None else tuple(r.notes), r.error) for r in out), key=str)
    want = sorted((t for i, d in enumerate(docs) for t in walked(i, d)), key=str)
    assert got == want and len(want) > 100
    assert all(r.planned == any("10b5-1" in n for n in r.notes) for r in out if r.error is None)


def test_topic_signal(spark):
    """alpha: (.6 + .2) / 2 = .4 over two; beta: half of .6 = .3, once.  (.4 x sqrt 2 x 1.5 + .3) / (1.5 sqrt 2 + 1)."""
    df = spark.createDataFrame([("g", "alpha", "beta", 0.6), ("g", "alpha", "", 0.2), ("h", "beta", "", -0.3), ("h", "beta", "", -0.3)], "k string, topic string, topic_secondary string, adjusted double")
    got = {r.k: r for r in N.topic_signal(df, ["k"], strong=("alpha",), litigation="beta", earnings="alpha").collect()}
    root = 1.5 * 2**0.5
    assert round(got["g"].signal - (0.4 * root + 0.3) / (root + 1), 9) == 0 and got["g"].direction == "bullish" and got["g"].earnings_alert and not got["g"].litigation_alert
    assert got["h"].direction == "bearish" and got["h"].litigation_alert and not got["h"].management_alert and got["h"].confidence == 0.2
