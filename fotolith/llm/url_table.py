"""The small labelled table of URLs: words of hosts to block and to allow, and the rule that makes URLs of them.

Both labels get the same shapes, domains and paths in turn, so that only words tell them apart.
"""

from __future__ import annotations

# Words met in hosts to block (gambling, drugs, adult, loans, fakes, piracy, fraud, tracking, spam), and in hosts to allow.
BLOCK = """casino poker slots roulette jackpot lottery bingo gambling bets betting wager blackjack viagra cialis pills pharmacy meds rx steroids slimming
xxx adult porn sex cams webcam nude escort dating hookup erotic milf loans payday cash credit debt bitcoin forex profit doubler replica fake counterfeit outlet
crack keygen warez serials nulled torrent cheats hack verify login account winner prize claim giveaway survey reward virus cleaner toolbar ads adserver banner popup
click clicks tracker tracking pixel affiliate redirect spam backlinks seo followers likes bulk mailer doorway linkfarm miracle cure psychic horoscope clickbait discount cheap bonus free""".split()
ALLOW = """news daily times herald journal gazette library museum theatre gallery school college university academy institute science physics chemistry biology
history geography math language grammar dictionary wiki encyclopedia archive docs manual code software kernel python weather climate ocean river mountain forest
garden flowers birds animals recipes kitchen bakery coffee travel trains railway airport hotel city town council government court law health hospital clinic nursing
sports football chess cycling running hiking music choir opera radio cinema film poetry books press publishing letters family parenting children craft knitting
wood bicycle repair farm market economy trade bank energy solar space astronomy map county village harbour""".split()
#: How many hosts each word begins.
HOSTS = 6
SHAPES = ("{a}-{b}", "{a}{b}", "{a}", "the-{a}-{b}", "{a}{n}", "my{a}-{b}")
DOMAINS = ("com", "example.com", "net", "example.org", "org", "info", "example.net", "co")
FRONT = ("", "www.", "m.", "blog.", "", "www.")
PATHS = ("/", "/en/{n}.html", "/{b}/{n}", "/index.php", "/de/{n}", "/2020/05/{a}-{b}", "/es/{n}.html", "")


def labelled_urls(block: list[str] = BLOCK, allow: list[str] = ALLOW) -> list[tuple[str, int]]:
    """(url, 1 for a URL to block): HOSTS for each word, joined with other words of its label, in turn over shapes, domains and paths."""
    out = []
    for words, label in ((block, 1), (allow, 0)):
        for i, a in enumerate(words):
            for k in range(HOSTS):
                n, b = i * HOSTS + k, words[(i + 7 * k + 3) % len(words)]
                host = FRONT[(i + k) % len(FRONT)] + SHAPES[k % len(SHAPES)].format(a=a, b=b, n=n) + "." + DOMAINS[(i + 3 * k) % len(DOMAINS)]
                out.append((f"http{'s' * (n % 2)}://{host}{PATHS[(i + 5 * k) % len(PATHS)].format(a=a, b=b, n=n)}", label))
    return out
