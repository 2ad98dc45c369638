from __future__ import annotations

import hashlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tandem.llm import chat_format as C
from tandem.llm import url_filter as U
from tandem.llm.url_filter import judge_sql, judge_urls

import pyarrow as pa

PIECES = st.lists(st.sampled_from(["<|end|>", "<|turn|>", "\\", "<", "[", "INST]", "/INST]", "</s>", "<s>", "|x|>", "\n", "é😀", "a", "<<SYS>>", "<</SYS>>", "n"]), max_size=12).map("".join)


@settings(max_examples=400, deadline=None)
@given(st.lists(st.tuples(PIECES, PIECES), min_size=1, max_size=5))
def test_round_trip(turns):
    out, offsets, _ = C.assemble(pa.array([r for r, _ in turns], pa.string()), pa.array([t for _, t in turns], pa.string()))
    assert C.read_back(out.tobytes().decode()) == turns
    assert offsets[-1] == len(out)


def test_chat_digest(spark):
    rows = [(1, 1, "assistant", "b<|end|>\né"), (1, 0, "user", None), (1, 2, None, "x"), (2, 0, "assistant", ""), (None, 0, "user", "n"), (1, 3, "assistant", "[INST]"), (3, 0, "a\nb\\n", "<\\|end|>")]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r for r in C.chat_digest(C.with_probe(spark, frame)).collect()}
    rows += C.EXTRA
    for conv in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == conv), key=lambda r: r[1])
        turns = "".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in own)
        loss = "".join(r[3] for r in own if r[2] == "assistant")
        assert (got[conv].n_turns, got[conv].turns_sha256, got[conv].loss_chars, got[conv].loss_sha256) == (len(own), hashlib.sha256(turns.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert C.chat_digest(frame.limit(0)).count() == 0


def test_a_conversation_of_many_parts(spark):
    """Long conversations cut by ranges and by the bytes of a part: the digests are those of one part."""
    rows = [(1, i, "assistant" if i % 2 else "user", f"turn {i} <|end|> é" * (i % 7)) for i in range(900)] + [(1, 5, "user", "again"), (1, 5, "user", "again")]
    rows += [(2, i, "user", "x" * 3000 * i) for i in range(4)] + [(None, i, "assistant", "n") for i in range(40)]
    frame = spark.createDataFrame([(*r, "p", 0) for r in rows], "conv_id long, turn long, role string, text string, part string, loss int").repartition(7)
    parts = C.format_chats(frame, 500).collect()
    assert max(sum(p.conv_id == c for p in parts) for c in (1, 2)) > 50
    for conv in (1, 2, None):
        own = sorted((r for r in rows if r[0] == conv), key=lambda r: r[1:])
        text = "".join(p.text for p in sorted((p for p in parts if p.conv_id == conv), key=lambda p: p.part))
        assert C.read_back(text) == [(r[2], r[3]) for r in own]
    assert sorted(map(tuple, C.chat_digest(frame, 500).collect()), key=str) == sorted(map(tuple, C.chat_digest(frame.coalesce(1)).collect()), key=str)


RULED = [
    ("http://www.example.org/en/12", "www.example.org", "/en/12", "example.org/en/1", "block"),
    ("https://example.org/es/", "example.org", "/es/", "example.org/es/", "block"),
    ("https://example.org", "example.org", "", None, "allow"),
    ("http://a.com/de/x", "a.com", "/de/x", "com/de/", "block"),
    ("http://com/fr/", "com", "/fr/", "com/fr/", "allow"),
    ("http://xcom/de/", "xcom", "/de/", None, "allow"),
    ("org/", "", "", None, "allow"),
    ("http://EXAMPLE.ORG/es/#", "example.org", "/es/", "example.org/es/", "block"),
    ("http://casino-win.example.org/de/", "casino-win.example.org", "/de/", "org/", "allow"),
    ("http://A.É.com:80?x/y", "a.É.com:80", "", None, "allow"),
    ("a://b://c/d", "b:", "//c/d", None, "allow"),
    (None, "", "", None, "allow"),
    ("", "", "", None, "allow"),
]
STRICT = ["http://porn.net/", "http://a.net/x?q=VIAGRA", "http://a.net/a?t=xxx", "http://a.net/#keygen", "viagra", "http://é.net/éxxxé", "http://viagra2.net/", "http://casino.net/"]
SOFT = ["http://sexy.net/nude", "http://a.net/#roulette,bets", "http://www.free-bets.net/", "casino-win.net", "http://cheap-pills.net/", "http://wetten.net/lotto", "http://a.net/online_pharmacy"]
CLEAN = ["http://sexy.net/sexy", "http://a.net/cheap-free", "http://alphabets.net/win", "http://a.net/freebetsy", "http://a.net/9xxx", "http://a.net/casinovale", "http://a.net/sexy/bets", "http://specialist.net/"]
#: Made up for this test, after the vocabulary was written.
BAD = """bestcasino.com pokerstars.com bet365.com/en/sports freeporn.net onlinepharmacy.biz casino-royale.net escort-girls.de apuestas-deportivas.es hotteens-webcam.net/amateur megacasino.example/vip
 tubeporno.net/videos mypornblog.info sexchatlive.org milf-dating.net adult-dating.com nude-teens.ru amateur-sex.net/xxx hentaiworld.jp lesbian-webcams.net hornygirls.net/horny/girls
 slots-online.net blackjack.info roulette-bets.com livebetting.co topslots.bet casinoslot777.net lucky-jackpot-slots.com sportwetten24.de spielautomaten.de/gratis tragaperras.es
 paris-sportifs.fr/cotes football-odds.net/betting poker-tips.net loteria-bingo.es bingo-slots.co.uk
 buyviagra.ru cheapmeds.net order-pills.com kamagra-shop.eu pharmacy-rx.biz discount-pharmacy.net cialis-generic.net rezeptfrei-kaufen.de farmacia.es/pastillas buy_steroids.net
 keygenhub.net serials-cracks.org free-torrents.net/crack warezworld.net payday-loans.biz replica-watches.cn sin-receta.es/farmacia kontakte-erotik.de chicas-sexo.es rencontre-sexe.fr""".split()
GOOD = """news.org/free/trojan-horse-history farm.org/virus/research uni.edu/cancer/adult/screening/online shop.com/buy/webcam amateur-astronomy.org/free middlesex.ac.uk/study essex.gov.uk/jobs specialist-care.org
 popcorn.com/recipes adult-education.edu/courses school.edu/girls/football sussexbirds.org hospital.org/pharmacy/hours who.int/drugs/prices bank.com/online/order river-bank.org alphabet.com/letters scunthorpe.gov.uk
 cocktails.net/recipes pillow-shop.com pillars.org/history chess.com/play/online game.com/slot/save museum.org/nude-painting dictionary.com/define/naked expat.de/wetter lotterie-gesetz.de/text paris.fr/culture
 parislibrary.fr/livres cookery.com/best/pie deal-law.org/win-win analytics.io/track farmers.org/animals winchester.gov.uk xkcd.com/x cialdini.com/books python.org/free/download garden.net/hot/peppers
 library.edu/serial/novels water.gov/torrent-river therapist.com/couples analysis.org/data assess.net/exam bass-guitar.com/strings betsy-ross.org/flag betting-commission.gov/report casement.com/windows
 cashmere.co/shop teenlibrary.org/books dating-fossils.edu/carbon sexton.org/family weather.com/odds-of-rain mature-cheese.com/cheddar strip-mining.org/coal fetishism-essay.edu/marx security.org/exploit/patch
 football.de/quoten voting.gov/lottery-draw police.uk/escort-duty""".split()


def all_urls():
    return [*(r[0] for r in RULED), *STRICT, *SOFT, *CLEAN, *(f"http://{'a' * 50_000}.net/?{x}" for x in ("xxx", "yyy")), STRICT[0], STRICT[0]]


def test_urls(spark):
    urls = all_urls()
    frame = spark.createDataFrame([(i, u, "other") for i, u in enumerate(urls)], "page_id long, url string, verdict string")
    got = [tuple(r) for r in judge_urls(frame).orderBy("page_id").collect()]
    assert [g[1:] for g in got[: len(RULED)]] == [r[1:] for r in RULED]
    verdicts = [g[4] for g in got[len(RULED) :]]
    assert verdicts == ["block"] * (len(STRICT) + len(SOFT)) + ["allow"] * len(CLEAN) + ["block", "allow", "block", "block"]
    assert judge_urls(frame.limit(0)).count() == 0


def test_urls_against_sql(spark):
    import duckdb

    rows = list(enumerate(all_urls()))
    con = duckdb.connect()
    con.execute("CREATE TABLE pages (page_id BIGINT, url VARCHAR)")
    con.executemany("INSERT INTO pages VALUES (?, ?)", rows)
    assert sorted(con.execute(judge_sql()).fetchall()) == [tuple(r) for r in judge_urls(spark.createDataFrame(rows, "page_id long, url string")).orderBy("page_id").collect()]


def test_unseen_urls(spark):
    """Precision and recall of the vocabulary on urls that it wasn't made from."""
    urls = [f"https://www.{u}" for u in [*BAD, *GOOD]]
    got = [r.verdict == "block" for r in judge_urls(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")).orderBy("page_id").collect()]
    hit, false = sum(got[: len(BAD)]), sum(got[len(BAD) :])
    missed, wrong = [u for u, b in zip(BAD, got, strict=False) if not b], [u for u, b in zip(GOOD, got[len(BAD) :], strict=True) if b]
    print(f"recall {hit / len(BAD):.3f}, precision {hit / (hit + false):.3f}, missed {missed}, wrong {wrong}")
    assert hit >= 0.9 * len(BAD) and false <= 0.1 * (hit + false)
    assert all(got[:8]) and not any(got[len(BAD) : len(BAD) + 5])


def test_a_vocabulary_of_ones_own(spark, monkeypatch):
    pages = spark.createDataFrame([(1, "http://a.net/foo"), (2, "http://a.net/foo/bar"), (3, "http://a.net/xxx"), (4, "http://bazaar.net/"), (5, "http://a.net/bazaar"), (6, "http://a.net/bar/foo/qux")], "page_id long, url string")
    terms = spark.createDataFrame([("foo", "c", "en", "soft"), ("bar", "d", "de", "soft"), ("foo", "c", "de", "soft"), ("BAZ", "c", "en", "stem"), ("qux", "d", "en", "soft")], "term string, category string, language string, kind string")
    assert [r.verdict for r in judge_urls(pages, {}, terms).orderBy("page_id").collect()] == ["allow", "allow", "allow", "block", "allow", "block"]
    assert [r.verdict for r in judge_urls(pages, {}, terms, 1).orderBy("page_id").collect()] == ["block", "block", "allow", "block", "allow", "block"]
    monkeypatch.setattr(U, "MOST_TERMS", 2)
    with pytest.raises(ValueError):
        judge_urls(pages, {}, terms)
