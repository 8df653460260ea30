"""Pages written by hand, not drawn from the generator that trains the field: (html, main text)."""

A = "The river rose two metres overnight and flooded the lower town."
B = "Volunteers filled sandbags until the early morning, and no one was hurt."
C = "By Friday the water had gone down again, leaving mud in every cellar."
D = "Engineers now want to raise the dam, which was built in 1931."
H = "Flood in the lower town"

LINKS = "<ul><li><a href='/a'>Sports</a></li><li><a href='/b'>Weather</a></li><li><a href='/c'>Markets</a></li></ul>"
FULL = "\n".join((H, A, B, C))
PAGE = "<html><body>{}</body></html>"


def _article(inside="", after="", before="", tag="article", attributes=""):
    return PAGE.format(f"{before}<{tag}{attributes}><h1>{H}</h1><p>{A}</p>{inside}<p>{B}</p><p>{C}</p></{tag}>{after}")


WRITTEN = [
    # menus
    (_article(before=f"<nav>{LINKS}</nav>"), FULL),
    (_article(inside=f"<nav>{LINKS}</nav>"), FULL),
    (_article(before=f"<div class='menu'>{LINKS}</div>", tag="main"), FULL),
    (_article(inside=f"<nav class='toc'>{LINKS}</nav>", tag="main"), FULL),
    (_article(before=f"<div id='navigation'>{LINKS}</div>", tag="div", attributes=" id='content'"), FULL),
    (_article(inside=f"<nav>{LINKS}</nav>", tag="div", attributes=" class='post'"), FULL),
    # headers
    (_article(before="<header><div>The Valley Gazette</div><p>News since 1890</p></header>"), FULL),
    (PAGE.format(f"<article><header><h1>{H}</h1></header><p>{A}</p><p>{B}</p></article>"), "\n".join((H, A, B))),
    (_article(before="<div class='site-header'><a href='/'>The Valley Gazette</a></div>", tag="main"), FULL),
    (_article(before="<header id='masthead'><h2>The Valley Gazette</h2></header>", tag="div", attributes=" class='entry-content'"), FULL),
    # footers
    (_article(after="<footer><p>&copy; 2020 The Valley Gazette</p></footer>"), FULL),
    (_article(after="<div class='footer'>Contact us at the town hall</div>", tag="main"), FULL),
    (PAGE.format(f"<article><h1>{H}</h1><p>{A}</p><p>{B}</p><footer><p>Filed under rivers</p></footer></article>"), "\n".join((H, A, B))),
    (PAGE.format(f"<main><h1>{H}</h1><p>{A}</p><p>{B}</p><footer>Filed under rivers and dams</footer></main>"), "\n".join((H, A, B))),
    (PAGE.format(f"<div id='content'><h1>{H}</h1><p>{A}</p><p>{B}</p><footer class='entry-footer'><span>Tagged: rivers</span></footer></div>"), "\n".join((H, A, B))),
    # sidebars
    (_article(after=f"<aside><h3>Related</h3>{LINKS}</aside>"), FULL),
    (_article(inside="<aside><p>The gauge at the bridge has been read daily since 1850.</p></aside>"), FULL),
    (_article(inside=f"<aside><h3>Related</h3>{LINKS}</aside>", tag="main"), FULL),
    (_article(inside="<aside class='sidebar'><h3>In numbers</h3><p>Two metres, forty houses.</p></aside>", tag="div", attributes=" class='article-body'"), FULL),
    (_article(after=f"<div class='related'><h4>Read also</h4>{LINKS}</div>", tag="div", attributes=" id='main'"), FULL),
    (_article(inside=f"<aside>{LINKS}</aside>", tag="main"), FULL),
    # notices
    (_article(before="<div class='cookie-banner'>We use cookies to improve this site. <button>Accept</button></div>"), FULL),
    (_article(inside="<div class='newsletter-signup'><p>Get our stories every morning.</p></div>"), FULL),
    (_article(inside="<div class='notice'>Subscribe to our newsletter</div>", tag="main"), FULL),
    (_article(inside="<div id='paywall'><p>Three free stories are left this month.</p></div>", tag="div", attributes=" class='story'"), FULL),
    (_article(after="<div class='newsletter'><p>Subscribe and never miss a story.</p></div>", tag="main"), FULL),
    # adverts
    (_article(before="<div class='ad-slot'>Buy two boots, pay one</div>"), FULL),
    (_article(inside="<div class='advert'><p>Buy two boots, pay one</p></div>"), FULL),
    (_article(inside="<aside class='sponsored'>Boots for every weather</aside>", tag="main"), FULL),
    (_article(inside="<div class='promo'>Boots for every weather, now cheaper than ever before.</div>", tag="div", attributes=" id='content'"), FULL),
    # forms
    (_article(before="<form class='search'><label>Search</label><input><button>Go</button></form>"), FULL),
    (_article(inside="<form class='signup'><label>Email</label><input><button>Send</button></form>"), FULL),
    (_article(inside="<form><label>Email</label><button>Send</button></form>", tag="div", attributes=" id='content'"), FULL),
    (_article(inside="<form><p>Tell us what you saw.</p><button>Send</button></form>", tag="main"), FULL),
    # comments
    (_article(after="<section class='comments'><h3>Comments</h3><p>I was there and it was worse than that.</p><p>Well written, thank you.</p></section>"), FULL),
    (_article(inside="<div class='comment-list'><p>I was there and it was worse than that.</p></div>"), FULL),
    (_article(after="<div id='disqus_thread'><div class='comment'><p>Where can I donate to the town?</p></div></div>", tag="main"), FULL),
    # share lines
    (_article(inside="<div class='share'>Share this: <a href='#'>Mail</a></div>"), FULL),
    (PAGE.format(f"<article><h1>{H}</h1><p class='byline'>By Ann Miller</p><p>{A}</p><p>{B}</p></article>"), "\n".join((H, A, B))),
    # several at once, and none
    (_article(before=f"<header><div>The Valley Gazette</div></header><nav>{LINKS}</nav>", inside="<div class='advert'>Boots</div>", after=f"<aside><h3>Related</h3>{LINKS}</aside><footer>Imprint</footer>"), FULL),
    (PAGE.format(f"<p>{A}</p><p>{B}</p>"), "\n".join((A, B))),
    (PAGE.format(f"<main><p>{A}</p><p>{B}</p></main><p>More stories</p>{LINKS}"), "\n".join((A, B))),
    (PAGE.format(f"<article><h1>{H}</h1><p>{A}</p><h2>What comes next</h2><ul><li>{D}</li><li>{C}</li></ul><blockquote><p>{B}</p></blockquote></article>"), "\n".join((H, A, "What comes next", D, C, B))),
    (PAGE.format(f"<article><h1>{H}</h1><p>{A} <a href='/dam'>The dam</a> held.</p><figure><img><figcaption>The bridge at noon</figcaption></figure><p>{B}</p></article>"), "\n".join((H, A + " The dam held.", "The bridge at noon", B))),
    (PAGE.format(f"<div class='post'><h1>{H}</h1><table><tr><td>Gauge</td><td>2.1 m</td></tr></table><p>{A}</p></div>"), "\n".join((H, "Gauge", "2.1 m", A))),
]

#: Written after the field was trained for those above; 14 pages, scored once before anything else was changed.
LATER = [
    (PAGE.format(f"<div class='wrapper'><ul class='nav'><li><a href='/'>Home</a></li><li><a href='/x'>About</a></li></ul><div class='text'><h2>{H}</h2><p>{A}</p><p>{D}</p></div></div>"), "\n".join((H, A, D))),
    (PAGE.format(f"<article><h1>{H}</h1><p>{A}</p><p>{D}</p><aside><h4>Most read</h4><ol><li><a href='/1'>Storm over the hills</a></li><li><a href='/2'>New mayor elected</a></li></ol></aside></article>"), "\n".join((H, A, D))),
    (PAGE.format(f"<main><nav><a href='/'>Home</a> / <a href='/news'>News</a></nav><h1>{H}</h1><p>{A}</p></main>"), "\n".join((H, A))),
    (PAGE.format(f"<article><p>{A}</p><div role='alert'>Your subscription ends soon.</div><p>{B}</p></article>"), "\n".join((A, B))),
    (PAGE.format(f"<article><p>{A}</p><p>{B}</p></article><section id='responses'><article><p>So sad to see this.</p></article><article><p>Stay safe, everyone.</p></article></section>"), "\n".join((A, B))),
    (PAGE.format(f"<div id='story'><p>{A}</p><div class='ad'>Advertisement</div><p>{B}</p><div class='ad'>Advertisement</div><p>{C}</p></div>"), "\n".join((A, B, C))),
    (PAGE.format(f"<section><h1>{H}</h1><p>{A}</p><pre>gauge = 2.1</pre><p>{B}</p></section><footer>Imprint and contact</footer>"), "\n".join((H, A, "gauge = 2.1", B))),
    (PAGE.format(f"<main><h1>{H}</h1><p>{A}</p><form action='/mail'><h3>Stay in touch</h3><label>Your address</label><button>Join</button></form><p>{B}</p></main>"), "\n".join((H, A, B))),
    (PAGE.format(f"<div class='content'><h1>{H}</h1><p>{A}</p><footer><p>Last changed on Friday</p></footer></div><div class='sidebar'><p>{D}</p></div>"), "\n".join((H, A))),
    (PAGE.format(f"<article><h1>{H}</h1><dl><dt>Where</dt><dd>{A}</dd><dt>When</dt><dd>{C}</dd></dl></article>"), "\n".join((H, "Where", A, "When", C))),
    (PAGE.format(f"<p>{A}</p><p>{B}</p><p>{C}</p><h3>Read next</h3>{LINKS}"), "\n".join((A, B, C))),
    (PAGE.format(f"<header><h1>The Valley Gazette</h1>{LINKS}</header><main><article><header><h1>{H}</h1></header><p>{A}</p></article></main>"), "\n".join((H, A))),
    (PAGE.format(f"<div class='modal'><p>Please log in to go on.</p></div><article><h1>{H}</h1><p>{A}</p><p>{B}</p></article>"), "\n".join((H, A, B))),
    (PAGE.format(f"<article><h1>{H}</h1><p>{A}</p><ul><li><a href='/map'>A map of the flooded streets</a> was drawn by the fire brigade.</li><li>{D}</li></ul></article>"), "\n".join((H, A, "A map of the flooded streets was drawn by the fire brigade.", D))),
]
