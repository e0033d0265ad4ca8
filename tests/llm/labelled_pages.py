"""Pages written and labelled by hand, in layouts that the training pages of ``html_tree`` don't have: ``(name, html, text)``.

No page shares a generator or a wording with the training set. The text is what a reader would call the article, one block a line.
"""

PAGES = [
    ("old table layout", """<HTML><BODY BGCOLOR=white><TABLE WIDTH=100%><TR><TD COLSPAN=2><IMG SRC=logo.gif><FONT SIZE=1><A HREF=/>Home</A> | <A HREF=/n>News</A> | <A HREF=/c>Contact</A></FONT></TD></TR>
<TR><TD WIDTH=120><A HREF=/a>Archive</A><BR><A HREF=/b>Books</A><BR><A HREF=/l>Links</A></TD><TD><H2>The ferry of Holm</H2><P>The ferry has crossed the sound every hour since the winter of 1921, and only two storms have stopped it.
<P>Its present captain, who took over from an uncle, keeps a log of every passenger who was carried free because of age or illness.<P>Last year there were four hundred of them.</TD></TR>
<TR><TD COLSPAN=2 ALIGN=CENTER><FONT SIZE=1>Copyright 1999 Holm Net. Mail the webmaster.</FONT></TD></TR></TABLE></BODY></HTML>""",
     "The ferry of Holm\nThe ferry has crossed the sound every hour since the winter of 1921, and only two storms have stopped it.\nIts present captain, who took over from an uncle, keeps a log of every passenger who was carried free because of age or illness.\nLast year there were four hundred of them."),
    ("documentation", """<!doctype html><html lang=en><head><title>Retry policy</title></head><body><div class="topbar"><a href="/">Docs</a><input type=search></div><div class="layout"><div class="sidebar-nav"><ul><li><a href=1>Install</a></li><li><a href=2>Configure</a></li><li><a href=3>Retry policy</a></li><li><a href=4>Limits</a></li></ul></div>
<main class="doc-page"><nav class="breadcrumb"><a href=/>Docs</a> / <a href=/g>Guides</a></nav><h1>Retry policy</h1><p>A request that fails with a status of 503 is sent again after a pause. The pause doubles after each attempt.</p><h2>Settings</h2><table><thead><tr><th>Name</th><th>Default</th></tr></thead><tbody><tr><td>attempts</td><td>5</td></tr><tr><td>first pause</td><td>200 ms</td></tr></tbody></table>
<pre>client.retry(attempts=3)</pre><p>Requests that change data are only repeated if they carry a key.</p></main><div class="toc-right"><p>On this page</p><a href=#s>Settings</a></div></div><footer><a href=/privacy>Privacy</a><p>Built with care in Oslo</p></footer></body></html>""",
     "Retry policy\nA request that fails with a status of 503 is sent again after a pause. The pause doubles after each attempt.\nSettings\nName\nDefault\nattempts\n5\nfirst pause\n200 ms\nclient.retry(attempts=3)\nRequests that change data are only repeated if they carry a key."),
    ("weblog", """<html><body class="home blog"><div id="page"><div id="masthead" role="banner"><h1><a href="/">A gardener's notes</a></h1><p>Mostly about beans</p></div><div id="primary"><div id="post-311" class="post type-post hentry"><h2 class="entry-title">Why the beans failed</h2><div class="entry-meta">Posted by Ana on 3 May <a href=#c>7 comments</a></div>
<div class="entry-content"><p>We sowed them a fortnight too early. The soil had not yet reached ten degrees, and half of the seed rotted before it could sprout.</p><blockquote><p>Sow beans when the elder blooms.</p></blockquote><p>That is what my grandfather said, and he was right.</p><div class="sharedaddy share-buttons"><span>Share this:</span><a href=f>Face</a><a href=t>Bird</a></div></div></div>
<div id="comments" class="comments-area"><h3>7 replies</h3><ol class="comment-list"><li class="comment"><p>Mine failed as well, it was a cold spring everywhere.</p></li><li class="comment"><p>Try soaking the seed for a night.</p></li></ol></div></div><div id="secondary" class="widget-area"><aside class="widget"><h2>Recent posts</h2><ul><li><a href=1>Pruning pears</a></li><li><a href=2>Slugs again</a></li></ul></aside></div><div id="colophon" class="site-footer">Proudly powered by a press</div></div></body></html>""",
     "Why the beans failed\nWe sowed them a fortnight too early. The soil had not yet reached ten degrees, and half of the seed rotted before it could sprout.\nSow beans when the elder blooms.\nThat is what my grandfather said, and he was right."),
    ("encyclopedia", """<html><body><div id="mw-head"><ul><li><a href=r>Read</a></li><li><a href=e>Edit</a></li><li><a href=h>View history</a></li></ul></div><div id="content" class="body"><h1 id="firstHeading">Alder</h1><div id="bodyContent"><p><b>Alders</b> are trees of the birch family. They grow near <a href=w>water</a> and fix nitrogen in <a href=n>nodules</a> of their roots.</p><div id="toc" class="toc"><h2>Contents</h2><ul><li><a href=#1>1 Uses</a></li><li><a href=#2>2 Folklore</a></li></ul></div>
<h2>Uses</h2><p>The wood does not rot under water, so that much of Venice stands on it.</p><h2>Folklore</h2><p>The cut wood turns from white to red, which people took for blood.</p></div></div><div id="mw-panel"><div class="portal"><a href=m>Main page</a><a href=c>Contents</a><a href=rnd>Random page</a></div></div><div id="footer"><ul><li>This page was last edited on 2 March.</li><li><a href=p>Privacy policy</a></li></ul></div></body></html>""",
     "Alder\nAlders are trees of the birch family. They grow near water and fix nitrogen in nodules of their roots.\nUses\nThe wood does not rot under water, so that much of Venice stands on it.\nFolklore\nThe cut wood turns from white to red, which people took for blood."),
    ("recipe", """<html><body><nav><a href=/>All recipes</a> <a href=/s>Soups</a> <a href=/b>Bread</a></nav><div class="consent-banner"><p>We and our 312 partners store information on your device.</p><button>Accept</button></div><article class="recipe"><h1>Rye bread</h1><p>A dense loaf that keeps for a week.</p><h2>Ingredients</h2><ul><li>500 g rye flour</li><li>10 g salt</li><li>350 g water</li></ul><h2>Method</h2><ol><li>Mix everything and leave it for twelve hours.</li><li>Bake at 220 degrees for an hour.</li></ol><p aria-hidden="true">Best on the second day.</p></article>
<section class="related"><h3>You might also like</h3><a href=1><div>Oat bread</div></a><a href=2><div>Flat bread</div></a></section><form class="newsletter"><label>Recipes in your inbox</label><input type=email><button>Sign up</button></form><footer>All rights reserved</footer></body></html>""",
     "Rye bread\nA dense loaf that keeps for a week.\nIngredients\n500 g rye flour\n10 g salt\n350 g water\nMethod\nMix everything and leave it for twelve hours.\nBake at 220 degrees for an hour.\nBest on the second day."),
    ("news without landmarks", """<html><body><div class="hdr"><span>The Morning Courier</span><a href=1>Politics</a><a href=2>Sport</a><a href=3>Weather</a></div><div class="wrap"><div class="col-a"><div class="story-body"><h1>Bridge closed for a year</h1><div class="byline">By a staff reporter</div><p>The council has closed the old bridge after divers found cracks in two of its five piers.</p><p>Buses will go round by the mill, which adds eleven minutes to the journey.</p><div class="ad-slot">Advertisement Drive the new Comet today</div><p>Repairs are to cost nine million.</p></div></div><div class="col-b"><div class="most-read"><h4>Most read</h4><ol><li><a href=4>Mayor resigns</a></li><li><a href=5>Cup final moved</a></li></ol></div></div></div><div class="ftr">Contact us Terms Imprint</div></body></html>""",
     "Bridge closed for a year\nThe council has closed the old bridge after divers found cracks in two of its five piers.\nBuses will go round by the mill, which adds eleven minutes to the journey.\nRepairs are to cost nine million."),
    ("formula", """<html><body><header><a href=/>Lecture notes</a></header><main><h1>Falling bodies</h1><p>The way grows as the square of the time, <math><mi>s</mi><mo>=</mo><mn>5</mn><msup><mi>t</mi><mn>2</mn></msup></math> in metres and seconds.</p><p>Air slows light bodies more than heavy ones.</p></main><footer>Term of 2019</footer></body></html>""",
     "Falling bodies\nThe way grows as the square of the time, s=5t2 in metres and seconds.\nAir slows light bodies more than heavy ones."),
    ("question and answer", """<html><body><header class="top"><a href=/>Ask</a><a href=/t>Tags</a></header><div id="mainbar"><article class="question"><h1>How do I sharpen a scythe?</h1><p>Mine only bends the grass. I have a stone, but no idea at which angle to hold it.</p><p>The blade is about seventy centimetres long and has not been peened.</p></article></div><div id="sidebar"><h4>Linked</h4><a href=1>How to peen a blade</a><h4>Hot questions</h4><a href=2>Which oil for a saw?</a></div><footer><p>Site design and logo are ours</p></footer></body></html>""",
     "How do I sharpen a scythe?\nMine only bends the grass. I have a stone, but no idea at which angle to hold it.\nThe blade is about seventy centimetres long and has not been peened."),
]
