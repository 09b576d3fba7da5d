"""Pages written for the tests from a list of mark-up features: a place with rooms, a list of firms, a society's site, a walk."""

PLACE_URL = "https://kilnhouse.example/stay"
PLACE = """<!DOCTYPE html><html lang="en-GB"><head><meta charset="utf-8"><link rel="canonical" href="https://kilnhouse.example/stay">
<title>Stay - Kilnhouse</title><meta name="ICBM" content="55.6721, -2.4417">
<meta property="og:image" content="https://media.kilnhouse.example/yard.jpg?width=1400"><meta property="og:title" content="Kilnhouse">
<meta name="description" content="Weekend pottery courses in an old mill, with guest rooms above the workshop."></head>
<body><main>
<table id="reach-us"><caption>Reach us</caption>
<tr><th>Telephone</th><td>+44 1835 55 01 77</td></tr><tr><th>WhatsApp</th><td>+44 7700 90 01 42</td></tr>
<tr><th>Email</th><td><a href="mailto:hello@kilnhouse.example">hello@kilnhouse.example</a></td></tr>
<tr><th>Opening hours</th><td>Thursday to Sunday 10:00-16:30</td></tr></table>
<h1>Kilnhouse</h1>
<p>The mill was rebuilt by its potters over six winters. Courses run from a Friday evening to a Sunday lunch, and most guests sleep upstairs.</p>
<ol class="facilities"><li>Drying room</li><li>Two gas kilns</li><li>Shared kitchen</li></ol>
<h3>Rooms</h3><ol class="room-types"><li>Loft Twin</li><li>Millrace Double</li></ol><div class="price">from GBP 64 per night</div>
<div class="slider"><figure><img srcset="https://media.kilnhouse.example/s/wheel-500.jpg 500w, https://media.kilnhouse.example/s/wheel-1500.jpg 1500w" alt="Wheel"></figure>
<figure><img data-lazy-src="https://media.kilnhouse.example/s/glaze.jpg" src="data:image/png;base64,BBBB" alt="Glaze shelf" width="900" height="600"></figure>
<figure><a href="https://media.kilnhouse.example/s/firing-full.jpg"><img src="https://media.kilnhouse.example/s/firing-small.jpg" alt="Firing" width="820" height="540"></a></figure></div>
<figure class="board"><img src="https://media.kilnhouse.example/menu-summer.jpg" alt="Summer menu" width="700" height="990"><figcaption>Our menu</figcaption></figure>
<p><b>General Manager</b> Isla Renwick</p>
</main><footer><a href="https://www.facebook.com/kilnhousepots">Facebook</a> <a href="https://twitter.com/share?url=k">Tweet this</a>
<small>Charity number 9988776655</small></footer>
<script type="application/ld+json">[{"@context":"https://schema.org","@type":"WebPage","inLanguage":"en-GB"},
{"@context":"https://schema.org","@type":"LodgingBusiness","name":"Kilnhouse","telephone":"+44 1835 55 01 77",
"address":{"@type":"PostalAddress","streetAddress":"Old Mill, Weirside","addressLocality":"Selham","postalCode":"TD9 4QX","addressCountry":"GB"},
"geo":{"latitude":"55.6721","longitude":"-2.4417"}}]</script></body></html>"""


def firm(name, place, phone, picture):
    return (
        f'<li class="firm"><a href="/firms/{picture}"><img src="/pics/{picture}-s.png" data-original="/pics/{picture}.png" alt="" width="240" height="160"></a>'
        f'<h3 class="firm-name">{name}</h3><div>Category: <em>Clock repair</em></div><address>{place}</address><a href="tel:{phone.replace(" ", "")}">{phone}</a></li>'
    )


FIRMS_URL = "http://trades.example/clocks"
FIRMS = [
    ("Pendulum Works", "Unit 4, Harbour Lane, Eastwick", "041 555 0132", "pendulum"),
    ("Escapement", "88 Tanner Street, Eastwick", "041 555 0147", "escapement"),
    ("Mainspring and Daughters", "2 Chapel Row, Holm", "042 555 0109", "mainspring"),
]
FIRM_LIST = (
    "<html><head><title>Clock repair in the county</title></head><body>"
    '<ul class="menu"><li><a href="/">All trades</a></li><li><a href="/saddlers">Saddlers</a></li><li><a href="/tuners">Piano tuners</a></li><li><a href="/binders">Book binders</a></li></ul>'
    f'<section id="found"><ul class="firms">{"".join(firm(*f) for f in FIRMS)}</ul></section>'
    '<div class="sponsor"><img src="/promo/oil-468x60.gif" width="468" height="60"></div></body></html>'
)

SOCIETY = "http://tidewatch.example"
SOCIETY_PAGES = {
    f"{SOCIETY}/": """<html><head><title>Tidewatch Society</title><meta name="description" content="Volunteers who measure the estuary every month.">
<script type="application/ld+json">{"@type":"Organization","name":"Tidewatch Society"}</script></head><body><h1>Tidewatch Society</h1>
<p>Since the great flood our volunteers have measured the estuary once a month, in all weathers, and shared every figure with the harbour office.</p>
<ul><li><a href="/people.html">Our team</a></li><li><a href="/contact.html">Contact</a></li><li><a href="/photos.html">Photos</a></li></ul></body></html>""",
    f"{SOCIETY}/people.html": "<html><head><title>Our team</title></head><body><h1>Our team</h1><p>Forty people take turns with the gauge; the oldest has done so for thirty-one years.</p></body></html>",
    f"{SOCIETY}/photos.html": "<html><head><title>Photos</title></head><body><h1>Photos</h1><div class='gallery'><img src='/p/gauge.jpg' width='1000' height='700' alt='Gauge'><img src='/p/ebb.jpg' width='1000' height='700' alt='Ebb'></div></body></html>",
    f"{SOCIETY}/contact.html": """<html><head><title>Contact</title></head><body><h2>Contact</h2><ul><li>Telephone: +353 21 555 0186</li><li>Address: 7 Signal Terrace, Cobh, P24 XY10</li></ul>
<p>Write to <a href="mailto:post@tidewatch.example">post@tidewatch.example</a> or see <a href="https://www.facebook.com/tidewatchsociety">our page</a>.</p></body></html>""",
}


def walk_page(n, last=3, per_page=3):
    """Page ``n`` of a list of ferries."""
    rows = "".join(
        f'<article class="ferry"><h2>Ferry {i}</h2><div class="pier">Pier {i}, {10 + i} Quayside, Northport</div><a href="tel:043555{i:04d}">043 555 {i:04d}</a></article>'
        for i in range((n - 1) * per_page + 1, n * per_page + 1)
    )
    onward = f'<a rel="next" href="/ferries?page={n + 1}">Further</a>' if n < last else f'<a rel="prev" href="/ferries?page={n - 1}">Nearer</a>'
    return f"<html><head><title>Ferries</title></head><body><h1>Ferries</h1><div id='list'>{rows}</div><p>{onward}</p></body></html>"
