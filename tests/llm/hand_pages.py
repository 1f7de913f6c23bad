"""Pages written by hand in shapes that the training pages lack, and the text blocks that an extractor should give."""

LOREM = [
    "The river had been rising since Tuesday, and by the weekend the lower meadows lay under a sheet of brown water.",
    "Nobody in the village could remember a spring as wet as this one, although the older people spoke of a flood in their childhood.",
    "Engineers from the county arrived on Sunday with pumps and sandbags, and they worked through the night along the old wall.",
    "By morning the level had fallen a little, but the road to the station stayed closed and the school did not open.",
    "A second wave is expected later this week, when the snow in the hills begins to melt.",
]
L = LOREM

PAGES = [
    (  # a blog of nothing but div elements, classes without meaning
        f"""<html><body><div class=w1><div class=t><a href=/>My place</a> <a href=/about>About</a> <a href=/rss>RSS</a></div>
<div class=k><div class=z><h2>Notes on a flood</h2><div>{L[0]}</div><div>{L[1]} <em>Truly.</em></div><div>{L[2]}</div></div></div>
<div class=r><a href=/1>Older</a><a href=/2>Newer</a></div><div class=b>Copyright 2021 me. All rights reserved.</div></div></body></html>""",
        ["Notes on a flood", L[0], L[1] + " Truly.", L[2]],
    ),
    (  # a page of the nineties, laid out by tables
        f"""<html><body bgcolor=white><table width=100%><tr><td colspan=2><h1><a href=/>County Herald</a></h1></td></tr>
<tr><td valign=top width=120><a href=/n>News</a><br><a href=/s>Sport</a><br><a href=/w>Weather</a><br><a href=/c>Contact</a></td>
<td><h2>Road closed after flood</h2><p>{L[0]}<p>{L[1]}<p>{L[2]}<p>{L[3]}</td></tr><tr><td colspan=2>Copyright County Herald 1998</td></tr></table></body></html>""",
        ["Road closed after flood", L[0], L[1], L[2], L[3]],
    ),
    (  # a modern news page: byline, figure, aside in the article, share bar, related stories, newsletter
        f"""<!doctype html><html lang=en><head><title>x</title></head><body><div id=cookie-banner class="consent"><p>We value your privacy. We and our partners use cookies.</p><button>Accept</button></div>
<header class=site-header><nav><ul><li><a href=/>Home</a><li><a href=/world>World</a></ul></nav></header>
<main id=main><article class="story"><h1>Meadows under water</h1><p>{L[0]}</p><figure><img src=a.jpg><figcaption>The lower meadows on Saturday, seen from the church tower.</figcaption></figure>
<p>{L[1]}</p><div class="ad-slot advert"><p>Advertisement. Buy dry boots now.</p></div><p>{L[2]}</p><h2>What comes next</h2><p>{L[4]}</p></article>
<div class="share-bar social"><a href=#>Share</a> <a href=#>Tweet</a></div>
<section class="related"><h3>Related stories</h3><ul><li><a href=/a>Snow in the hills</a></li><li><a href=/b>The wall that held</a></li></ul></section>
<section id=comments class=comments><h3>2 comments</h3><div class=comment><p>My grandmother always told us about the flood of her youth, it must have been much like this.</p></div></section></main>
<aside class=sidebar><h4>Most read</h4><ol><li><a href=/1>One</a></li><li><a href=/2>Two</a></li></ol></aside>
<footer><p>Terms of use, privacy policy. Published by the county.</p></footer></body></html>""",
        ["Meadows under water", L[0], "The lower meadows on Saturday, seen from the church tower.", L[1], L[2], "What comes next", L[4]],
    ),
    (  # documentation with code, a list of contents beside it and definition lists
        f"""<html><body><nav class=toc><p>Contents</p><ul><li><a href=#a>Install</a><li><a href=#b>Use</a></ul></nav><div role=main class="document body"><h1>The pump tool</h1>
<p>This tool reads the level of a river and starts a pump when it rises above the limit that you set.</p><pre>pump --limit 3.5 --river lower</pre>
<dl><dt>--limit</dt><dd>The level in metres from which the pump runs until the water falls again.</dd><dt>--river</dt><dd>The name of the gauge that is read every minute.</dd></dl>
<ul><li>It needs a gauge that speaks the common protocol.</li><li>It writes what it does to a file.</li></ul></div><div class=footer>Last updated on Sunday. <a href=/>Index</a></div></body></html>""",
        ["The pump tool", "This tool reads the level of a river and starts a pump when it rises above the limit that you set.", "pump --limit 3.5 --river lower", "--limit",
         "The level in metres from which the pump runs until the water falls again.", "--river", "The name of the gauge that is read every minute.",
         "It needs a gauge that speaks the common protocol.", "It writes what it does to a file."],
    ),
    (  # deep wrappers, the article late in the page after long menus, a form in the middle
        "<html><body><div id=page><div id=outer><div class=inner><div class='nav menu'><ul>" + "".join(f"<li><a href=/{k}>Menu entry {k}</a></li>" for k in range(25)) + f"""</ul></div>
<div class=row><div class=col><div class=panel><div class='post entry'><h1>A night at the wall</h1><p>{L[2]}</p><blockquote><p>{L[1]}</p></blockquote><p>{L[3]}</p>
<form class=subscribe><label>Your address</label><input><p>Get our letter every week.</p></form><p>{L[4]}</p></div></div></div></div></div></div>
<div id=legal class="legal footer"><p>We are not liable for anything that is written here.</p></div></div></body></html>""",
        ["A night at the wall", L[2], L[1], L[3], L[4]],
    ),
    (  # short article, long comments
        f"""<html><body><header><h1><a href=/>Village news</a></h1></header><main><article><h2>School closed</h2><p>The school stays closed on Monday.</p></article>
<section class="discussion" id=replies><h3>Replies</h3><div class=reply><p>{L[1]}</p></div><div class=reply><p>{L[3]}</p></div><div class=reply><p>{L[0]}</p></div></section></main>
<footer><p>Imprint</p></footer></body></html>""",
        ["School closed", "The school stays closed on Monday."],
    ),
    (  # a table of data in the article, an unclosed list, an open button in the header
        f"""<html><body><header><button>Menu<nav><a href=/>Home</a></nav></header><section class=content><h1>Levels of the week</h1><p>{L[0]}</p>
<table><tr><th>Day<th>Level<tr><td>Monday<td>2.1<tr><td>Tuesday<td>3.4</table><p>{L[4]}</p><ul><li>Upper gauge: out of order<li>Lower gauge: works</ul></section>
<div class=widget><p>Weather today: rain</p></div></body></html>""",
        ["Levels of the week", L[0], "Day", "Level", "Monday", "2.1", "Tuesday", "3.4", L[4], "Upper gauge: out of order", "Lower gauge: works"],
    ),
    (  # no headings, text in section elements, links within every paragraph
        f"""<html><body><div class=topbar>Call us: 0800 1234</div><main><section><p>{L[0]} <a href=/m>Map of the meadows</a>.</p></section><section><p>{L[1]} <a href=/h>History of floods</a>.</p></section>
<section><p>{L[2]}</p></section></main><div class="breadcrumbs"><a href=/>Home</a> / <a href=/n>News</a></div><div class="pagination"><a href=2>2</a> <a href=3>3</a></div></body></html>""",
        [L[0] + " Map of the meadows.", L[1] + " History of floods.", L[2]],
    ),
]
