"""Pages written by hand, of habits that the page maker lacks; what is between [[ and ]] is the article.

All were labelled before any model saw them. The page maker and the features were widened after PAGES had been measured,
so PAGES shows progress; FRESH was written after that, and nothing was changed after it was measured.
"""

PAGES = {
    "layout tables": """<html><body bgcolor=white><table width=100%><tr><td colspan=2><font size=5>Harbour Gazette</font> <a href=/>front</a> <a href=/old>archive</a></td></tr><tr><td width=120><a href=1>Ships</a><br><a href=2>Tides</a><br><a href=3>Crew</a></td>
<td>[[<h2>The lighthouse gets a new lamp</h2><p>After forty years the old lamp was taken down on Monday and carried to the museum.</p><p>The new one uses a tenth of the power and can be seen from eighteen miles away.</p>]]</td></tr><tr><td colspan=2><font size=1>Copyright 1999 Harbour Gazette. All rights reserved.</font></td></tr></table></body></html>""",
    "font and center": """<body><center><a href=i.html>Home</a> - <a href=p.html>Pictures</a> - <a href=m.html>Mail me</a></center><hr>[[<center><b>How I mend clocks</b></center><p>First take the back off and look for dust, which is the cause of most trouble.<p>Then oil the pivots with a needle, a very small drop on each, and wait for an hour.]]<hr><center>You are visitor number 10482</center></body>""",
    "blog with sidebar": """<div id=wrapper><div id=header><h1><a href=/>Slow Gardens</a></h1><p class=tagline>Notes from a wet hill</p></div><div id=content><div class="post hentry">[[<h2 class=entry-title>Planting garlic in autumn</h2><div class=entry><p>Garlic wants cold weather, so the cloves go into the ground before the first frost.</p><p>Set them a hand apart with the point upwards and cover them with straw.</p></div>]]<p class=postmetadata>Filed under <a href=c>Vegetables</a> | <a href=d>4 Comments</a></p></div></div><div id=sidebar><h2>Archives</h2><ul><li><a href=a>October</a></li><li><a href=b>September</a></li></ul><h2>Blogroll</h2><ul><li><a href=x>Hen diary</a></li></ul></div></div>""",
    "documentation": """<div class=navbar><a href=/>kit 2.1</a><input type=search placeholder="Search docs"></div><div class=toc><ul><li><a href=#a>Install</a></li><li><a href=#b>Options</a></li><li><a href=#c>Errors</a></li></ul></div><main role=main>[[<h1>Installing the tool</h1><p>Unpack the archive into a folder of your choice and add that folder to your path.</p><pre>tar xf kit.tar
export PATH=$PATH:$PWD/kit</pre><p>Run the check command afterwards; it prints the version and the folder it was started from.</p>]]</main><div class=pager><a href=p>Previous</a> <a href=n>Next</a></div><footer>Built with a generator. Last updated in May.</footer>""",
    "list article": """<nav class=menu><a href=/>Start</a><a href=/t>Travel</a><a href=/f>Food</a></nav><article>[[<h1>Five things to pack for the mountains</h1><p>The weather turns quickly above the trees, so take these with you even on a bright morning.</p><ol><li>A dry shirt, wrapped in a bag that keeps the water out.</li><li>A whistle, because shouting carries badly in the wind.</li><li>More water than you think you will need for the way back.</li></ol>]]</article><div class=share><a href=s1>Share</a><a href=s2>Tweet</a><a href=s3>Pin</a></div><div class=newsletter><form><p>Get our letter every week</p><input name=mail><button>Subscribe</button></form></div>""",
    "forum opening post": """<div class=topbar><a href=/>Board index</a> &raquo; <a href=/r>Repairs</a></div><div class=thread><div class=first-post>[[<h1>Chain slips under load</h1><p>My chain slips on the two smallest cogs whenever I stand up on the pedals, and I have already replaced it once.</p><p>The cogs look worn to me, but the shop says that they are fine for another season.</p>]]</div><div class="comments replies"><div class=comment><p>Change the cassette.</p></div><div class=comment><p>Same here, it was the cassette.</p></div></div></div><div class=footer>Powered by board software</div>""",
    "news with adverts": """<header><div class=logo>The Morning Post</div><ul class=nav><li><a href=1>World</a></li><li><a href=2>Sport</a></li></ul></header><div class=article-body>[[<h1>Council votes for a second bridge</h1><p>The council voted on Tuesday evening to build a second bridge across the river, eleven votes to six.</p>]]<div class=ad-slot><p>Advertisement: buy one mattress, get the second for half the price!</p></div>[[<p>Work is to begin in spring, and the old bridge will stay open until the new one is finished.</p>]]</div><div class=related><h3>More stories</h3><a href=3>School roof leaks again</a><a href=4>Market moves to the square</a></div><footer>Contact Imprint Privacy</footer>""",
    "cookie dialog last": """<article>[[<h1>Why bees dance</h1><p>A bee that has found flowers comes back to the hive and runs in a figure of eight.</p><p>The angle of the run tells the others where to fly, and its length tells them how far.</p>]]</article><div role=dialog class=consent-modal><h2>Your privacy choices</h2><p>We and our partners store information on your device. You can accept or reject this.</p><button>Accept all</button><button>Reject</button></div>""",
    "german": """<div class=kopf><a href=/>Startseite</a> <a href=/k>Kontakt</a></div><div class=inhalt>[[<h1>Das alte Rathaus wird renoviert</h1><p>Im nächsten Jahr wird das alte Rathaus von Grund auf erneuert, und die Ämter ziehen so lange in die Schule.</p><p>Die Arbeiten sollen achtzehn Monate dauern und kosten vier Millionen Euro.</p>]]</div><div class=fuss><a href=/i>Impressum</a> <a href=/d>Datenschutz</a></div>""",
    "russian": """<header><a href=/>Главная</a><a href=/n>Новости</a></header><main><article>[[<h1>В городе открыли новый парк</h1><p>В субботу в городе открыли новый парк, который строили три года, и на праздник пришли тысячи людей.</p><p>В парке посадили двести деревьев и сделали дорожки для велосипедов.</p>]]</article></main><footer><p>Все права защищены</p></footer>""",
    "chinese": """<nav><a href=/>首页</a><a href=/w>文化</a></nav><div class=content>[[<h1>古老的茶馆重新开放</h1><p>这家有一百多年历史的茶馆在关闭三年以后重新开放，许多老客人从很远的地方赶来。</p><p>店主说，他会保留原来的桌椅和菜单，也会在晚上安排说书和音乐。</p>]]</div><div class=footer>版权所有</div>""",
    "definition list": """<div id=menu><a href=a>A</a> <a href=b>B</a> <a href=c>C</a></div><div id=main>[[<h1>Words used by sailors</h1><dl><dt>Bow</dt><dd>The front end of a ship, which meets the waves first.</dd><dt>Stern</dt><dd>The rear end of a ship, where the rudder hangs.</dd><dt>Lee</dt><dd>The side that is turned away from the wind.</dd></dl>]]</div><div id=foot>Back to top</div>""",
    "data table": """<div class=breadcrumb><a href=/>Home</a> / <a href=/d>Data</a></div><article>[[<h1>Rain in the valley</h1><p>The table gives the rain of the last three years, as it was measured at the school.</p><table><tr><th>Year</th><th>Rain in millimetres</th></tr><tr><td>2019</td><td>812 in all</td></tr><tr><td>2020</td><td>774 in all</td></tr></table><p>The second year was the driest since the measurements began.</p>]]</article><div class=sidebar><p>Sponsored: cheap umbrellas</p></div>""",
    "recipe": """<ul class=site-nav><li><a href=1>Soups</a><li><a href=2>Cakes</a></ul><div class=recipe>[[<h1>Lentil soup for six</h1><p>This soup is better on the second day, so make it in the evening.</p><h2>What you need</h2><ul><li>Four hundred grams of brown lentils</li><li>Two onions and three carrots, cut small</li><li>One spoon of cumin</li></ul><h2>What to do</h2><p>Fry the onions until they are brown, add the rest with two litres of water, and let it simmer for an hour.</p>]]</div><form class=rating><label>Rate this recipe</label><input type=radio></form><section id=reader-comments><h3>Readers say</h3><p>My children loved it!</p></section>""",
    "author box": """<article>[[<h1>Walking to work</h1><p>For a year I have walked to work, four miles each way, in whatever weather there was.</p><p>I have learnt the names of nine dogs and have not had a single cold.</p>]]</article><div class=author-bio><img src=a.png><p>About the author: writes about cities.</p><a href=f>Follow</a></div><div class=tags><a href=t1>walking</a> <a href=t2>health</a></div>""",
    "paywall notice": """<div class=banner role=alert><p>You have two free articles left this month. Log in or subscribe.</p></div><header><a href=/>Weekly Review</a></header><main>[[<h1>The price of sand</h1><p>Sand is dug from rivers faster than the rivers can bring it, and builders feel it in their bills.</p><p>Desert sand is of no use to them, for the wind has made its grains too round.</p>]]</main><footer><a href=j>Jobs</a><a href=p>Press</a></footer>""",
    "deep wrappers": """<div><div><div><div class=x1><a href=/>Up</a></div><div><div><div class=x2>[[<div><h3>Notes on frost</h3></div><div><p>Frost forms on still nights when the ground gives off its warmth to a clear sky.</p></div><div><p>A thin cover of cloud is often enough to keep the garden safe until the morning.</p></div>]]</div></div></div></div></div></div>""",
    "figure and caption": """<nav><a href=/>News</a> <a href=/v>Video</a></nav><article>[[<h1>A whale in the bay</h1><figure><img src=w.jpg><figcaption>The whale came within a hundred metres of the pier.</figcaption></figure><p>Hundreds of people stood on the pier on Sunday to watch a young whale that had strayed into the bay.</p><p>It left with the tide in the evening, and the boats kept their distance.</p>]]</article><aside class=most-read><h4>Most read</h4><ol><li><a href=1>Storm on the way</a></li><li><a href=2>Ferry late again</a></li></ol></aside>""",
    "questions and answers": """<div class=top><a href=/>Help</a><form action=/s><input name=q><button>Search</button></form></div><section class=faq>[[<h1>Questions about your library card</h1><h2>How long is it valid?</h2><p>A card is valid for one year from the day on which it was issued.</p><h2>What if I lose it?</h2><p>Tell us as soon as you can, and we will block it and give you another one.</p>]]</section><div class=bottom>Was this page helpful? <button>Yes</button> <button>No</button></div>""",
    "scripts between": """<script>var menu = "<p>not text</p>";</script><div class=menu><a href=1>One</a><a href=2>Two</a></div><article>[[<h1>Mending a wooden boat</h1><p>Dry rot begins where rain water stands, so look under the seats first of all.</p>]]<script>track("view");</script><style>.a{color:red}</style>[[<p>Cut the soft wood out generously and let a new piece in with glue and copper nails.</p>]]</article><noscript></noscript><div class=footer-links><a href=t>Terms</a></div>""",
    "no classes": """<html><body><p><a href=a>Home</a> <a href=b>Contact</a> <a href=c>Search</a></p>[[<h1>On keeping a diary</h1><p>A diary need not be kept every day; it is enough to write when something has happened.</p><p>Read it again after ten years, and you will meet somebody whom you had forgotten.</p>]]<p><a href=d>Terms</a> <a href=e>Privacy</a></p></body></html>""",
    "short story": """<div class=head><b>Small Tales</b></div><div class=story>[[<p>&ldquo;You are late,&rdquo; said the miller.</p><p>&ldquo;The road was under water,&rdquo; said the boy, and he put the sack down on the step.</p><p>The miller looked at the sack, and then at the boy, and then he laughed until he had to sit down.</p>]]</div><div class=nextprev><a href=1>&laquo; Earlier tale</a> <a href=2>Later tale &raquo;</a></div>""",
    "press release": """<div class=masthead><a href=/>Company</a><a href=/p>Products</a><a href=/i>Investors</a></div><div class=release>[[<h1>New works manager appointed</h1><p>The company has appointed a new manager for its works on the coast, who will begin in March.</p><p>The works employ three hundred people and make pumps for ships and for mines.</p>]]</div><div class=legal><p>This site uses trademarks of their owners. Unauthorised use is prohibited.</p></div>""",
    "lecture notes": """<div class=course-nav><a href=1>Week 1</a><a href=2>Week 2</a><a href=3>Week 3</a></div><section>[[<h2>Week 2: Supply and demand</h2><p>A price rises when more people want a thing than there are things to be had.</p><h3>An example</h3><p>After a bad harvest bread becomes dear, and those who can will eat potatoes instead.</p>]]</section><section class=login><form><p>Sign in to see your marks</p><input><input><button>Log in</button></form></section>""",
    "review with comments": """<header class=site-header><a href=/>Filmhouse</a></header><div class=review>[[<h1>A quiet film about a loud town</h1><p>The camera hardly moves, and yet one never looks away from these faces.</p><p>It is a first film, and one can see that here and there, but it does not matter.</p>]]</div><div id=disqus_thread class=comments-area><h3>3 responses</h3><ol class=commentlist><li><p>I fell asleep, to be honest.</p></li><li><p>Best film of the year for me.</p></li></ol><form><textarea>Leave a reply</textarea></form></div>""",
    "mega menu": "<nav class=mega>" + "".join(f"<div><h4>Section {k}</h4><ul>" + "".join(f"<li><a href=/{k}/{j}>Topic {k} {j}</a></li>" for j in range(8)) + "</ul></div>" for k in range(6)) + """</nav><main>[[<h1>The museum buys a painting</h1><p>The museum has bought a painting that was thought to be lost for a hundred years.</p><p>It hung in a kitchen, where nobody had looked at it closely.</p>]]</main><footer><ul><li><a href=1>Visit</a></li><li><a href=2>Shop</a></li></ul></footer>""",
    "one long paragraph": """<div class=bar><a href=/>Essays</a></div>[[<p>There is a kind of silence that belongs to houses in which a clock has stopped, and one notices it only after some time, when one has sat down and taken up a book and read a page without remembering any of it; then one looks up, and sees the hands, and understands.</p>]]<div class=bar><a href=/r>Random essay</a></div>""",
    "event notice": """<div class=crumbs><a href=/>Town</a> &gt; <a href=/e>Events</a></div><div class=event>[[<h1>Summer market on the green</h1><p>The summer market takes place on the first Sunday of July, from nine in the morning until four.</p><p>Whoever wants a table should write to the town hall before the end of May.</p>]]</div><div class=social-links>Follow us: <a href=f>F</a> <a href=t>T</a></div>""",
    "sections of a report": """<header><p>Institute of Water</p></header><div class=report>[[<h1>State of the lakes</h1><h2>Summary</h2><p>Of forty lakes that were examined, thirty-one were clean enough to swim in.</p><h2>Method</h2><p>Samples were taken in every month, at the shore and in the middle, one metre below the surface.</p>]]</div><div class=download><a href=r.pdf>Download as PDF</a></div><div class=sidebar-right><h3>Latest reports</h3><p><a href=1>Rivers</a></p><p><a href=2>Wells</a></p></div>""",
    "spanish with notice": """<div class=aviso-cookies><p>Este sitio usa cookies propias y de terceros.</p><a href=c>Aceptar</a></div><div class=menu><a href=/>Inicio</a><a href=/d>Deportes</a></div><article>[[<h1>El tren vuelve al valle</h1><p>Después de veinte años sin servicio, el tren volverá a recorrer el valle a partir de septiembre.</p><p>Habrá seis viajes al día, y el billete costará lo mismo que el autobús.</p>]]</article><div class=pie>Todos los derechos reservados</div>""",
}

FRESH = {
    "kiln": """<div class=site-title><a href=/>Clay Corner</a></div><div class=links><a href=1>Glazes</a> <a href=2>Wheels</a> <a href=3>Kilns</a></div><div class=txt>[[<h1>Firing a kiln for the first time</h1><p>Let the pots dry for a week, because water that is left in the clay will burst them.</p><p>Raise the heat slowly in the first hours and leave the lid open by a finger.</p>]]</div><div class=end><a href=4>About us</a></div>""",
    "orchard": """<header><h1>County Herald</h1><nav><a href=1>Local</a><a href=2>Farming</a></nav></header><section id=story>[[<h2>Late frost harms orchards</h2><p>Growers in the county fear for half of their apples after three nights of frost.</p><p>Some lit small fires between the rows, but the wind carried the warmth away.</p>]]</section><section id=more><h3>Also in farming</h3><ul><li><a href=3>Milk price falls</a></li><li><a href=4>New tractor rules</a></li></ul></section>""",
    "violin": """<main><div class=lead>[[<h1>How a violin is varnished</h1><p>The varnish is rubbed on in many thin coats, and each must dry in the sun.</p>]]</div><div class=promo><p>Strings at half price until Friday!</p></div><div class=rest>[[<p>Too thick a coat takes the voice from the wood, and no one can give it back.</p>]]</div></main><footer>Made in the workshop</footer>""",
    "chess": """<p><a href=/>Index</a></p>[[<h2>A short game</h2><p>White gave up a pawn on the sixth move, and black took it without thinking for long.</p><p>Ten moves later the black king stood in the middle of the board with nowhere to go.</p><p>It is the kind of game that one shows to children.</p>]]<p><a href=/n>Next game</a></p>""",
    "french": """<div class=entete><a href=/>Accueil</a><a href=/c>Culture</a></div><article>[[<h1>La bibliothèque ouvre le dimanche</h1><p>À partir du mois prochain, la bibliothèque sera ouverte tous les dimanches de dix heures à dix-huit heures.</p><p>La ville a engagé quatre étudiants pour accueillir les lecteurs.</p>]]</article><div class=commentaires><h3>Commentaires</h3><p>Enfin !</p></div>""",
    "api": """<div class=sidebar><ul><li><a href=1>open</a></li><li><a href=2>read</a></li><li><a href=3>close</a></li></ul></div><div class=doc>[[<h1>read</h1><p>Reads bytes from an open file into a buffer and returns how many were read.</p><pre>n = read(file, buffer)</pre><p>At the end of the file it returns zero; an error is raised if the file was closed before.</p>]]</div><div class=feedback><form><label>Found a mistake?</label><textarea></textarea><button>Send</button></form></div>""",
    "village": """<table><tr><td><a href=1>History</a></td><td><a href=2>Church</a></td><td><a href=3>Inn</a></td></tr></table>[[<h1>The village pump</h1><p>Until 1931 all the water of the village came from the pump beside the church.</p><p>Children were sent there before school, and what they told each other was known everywhere by noon.</p>]]<hr><center><a href=m>Write to the webmaster</a></center>""",
    "cycling": """<div id=gdpr><p>We value your privacy.</p><button>Fine</button></div><div id=page><div id=top><a href=/>Rides</a> <a href=/g>Gear</a></div><div id=body>[[<h1>Over the pass in one day</h1><p>We left before sunrise, as the road lies in full sun from ten o'clock on.</p><p>At the top there was snow, and a man who sold coffee from a van.</p><h2>The way down</h2><p>Check your brakes before you start, for there are forty bends and few walls.</p>]]</div><div id=replies><p>Nice report!</p><p>When was this?</p></div></div>""",
    "japanese": """<div class=menu><a href=/>ホーム</a><a href=/k>観光</a></div><main>[[<h1>山の駅が百周年を迎える</h1><p>山の中にある小さな駅が今年で百周年を迎え、記念の列車が走ることになった。</p><p>駅の周りには古い桜の木があり、春には多くの人が写真を撮りに来る。</p>]]</main><footer>お問い合わせ</footer>""",
    "interview": """<nav><ul><li><a href=1>People</a></li><li><a href=2>Places</a></li></ul></nav><div class=interview>[[<h1>A talk with a baker</h1><p><b>When do you get up?</b></p><p>At two, and I have done so for thirty years, also on Sundays.</p><p><b>Do you still like bread?</b></p><p>I eat it every day, but only the end pieces, which nobody buys.</p>]]</div><aside><p>Support our magazine with a small gift.</p></aside>""",
}
