from strataquery.llm import link_trust as lt
from strataquery.llm.queries import URL_RULES
from tests.llm.test_link_trust import link, plain, table


def test_chains_deeper_than_ten_links(spark):
    """Hosts 1 to 40 link towards a blocked host, in 100 hosts; the plain version takes 400 steps."""
    pages = [("http://bad.com/en/1", "")] + [(f"http://h{i}.io/", link(f"h{i - 1}.io" if i > 1 else "bad.com")) for i in range(1, 41)]
    pages += [(f"http://lone{i}.io/", "") for i in range(59)]
    want = plain(pages, URL_RULES, steps=400)
    assert "h16.io" in want and "h17.io" not in want
    assert {r["host"] for r in lt.host_verdicts(table(spark, pages), URL_RULES).collect()} == want
