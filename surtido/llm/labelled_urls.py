"""The small labelled table of URLs that the URL model is fitted on.

Hosts and paths are invented. Each side has hosts of one word, of several run together and of several
with hyphens, subdomains, numbers, all kinds of ends and paths of all kinds, so that only what words
and paths say tells the sides apart: gambling, adult, counterfeit pills, loans, pirated files,
link farms, trackers and ad servers are to block; news, schools, libraries, shops, clubs and private pages are not.
"""

from __future__ import annotations

# Host and path of URLs to block
BLOCK = """
casino-royal.example.com /slots/free-spins
www.luckycasino.example.net /en/bonus
casinowinners.example.com /jackpot
win-big-casino.example.org /play-now/
megawin.example.com /casino/slots.html
online-poker-bets.example.net /signup-bonus
pokerbonus247.example.com /deposit
m.slots-jackpot.example.com /spin/12
bestbetting.example.org /odds/free-bets
free-bets-today.example.com /claim
bets4free.example.net /en/77
sportsbetting-tips.example.com /bet/now
blackjack-roulette.example.net /table/live-dealer
gamblerz.example.com /win/cash
freecash.example.com /win-prizes/
prize-winner.example.net /claim-your-prize
www.free-prizes.example.org /survey/win
giveaway-free.example.com /iphone-winner
cheap-pills.example.com /buy-online
cheappills24.example.net /order/no-prescription
www.buy-cheap-meds.example.org /discount/pills
pharmacy-pills-online.example.com /cart
pillstore.example.net /viagra-cialis
discountmeds.example.com /generic/pills.html
diet-pills-fast.example.com /lose-weight
weightlossmiracle.example.org /buy/now
steroids-shop.example.net /order
replica-watches.example.com /cheap/rolex
cheapreplica.example.net /outlet/handbags
fake-diploma.example.org /buy-degree
adult-x.example.com /free-videos
adultcams.example.net /live/girls
xxx-videos.example.com /hd/1
freexxx.example.org /porn/clips
hotporn.example.net /tube/watch
sexcams-live.example.com /chat
www.sexdating.example.net /join-free
adult-dating.example.org /meet/singles
escort-girls.example.com /city
nude-cams.example.net /x/33
erotic-x-stories.example.com /adult
ads-track.example.com /click
track-ads.example.net /pixel.gif
adserver.example.com /banner/728x90
ads.example.org /serve/popunder
clicktrack.example.net /redirect/aff_id
www.ad-click-tracker.example.com /imp
popup-ads.example.org /show/interstitial
trackingpixel.example.com /collect
m.bannerads.example.net /rotate
affiliate-tracker.example.com /go/out.php
doubleads.example.com /adclick
spam-farm.example.com /links
linkfarm.example.net /directory/seo-links
www.buy-backlinks.example.org /seo/cheap
seo-spam.example.com /link-exchange
spamblog.example.net /auto/content
articlespinner.example.com /spin/seo
mass-mailer-spam.example.org /bulk-email
farm-of-links.example.net /page/99
payday-loans.example.com /instant-approval
quickloans.example.net /bad-credit/apply
cash-loan-fast.example.org /apply-now
instantcredit.example.com /loan/no-check
debt-free-now.example.net /consolidate
make-money-fast.example.com /work-at-home
easymoneyonline.example.org /earn-cash
get-rich-quick.example.net /forex-robot
crypto-doubler.example.com /invest/bitcoin-bonus
bitcoinprofit.example.net /trading-bot
forex-scam-signals.example.org /vip
miracle-invest.example.com /guaranteed-returns
warez-download.example.com /cracked/keygen
crackz.example.net /serials/key
free-torrents.example.org /download/full-movie
torrentfiles.example.com /pirate/dvdrip
keygen-crack.example.net /patch.exe
moviez-streaming.example.com /watch-free-hd
hacked-accounts.example.org /cheats
gamecheats.example.net /unlimited-coins-hack
malware-cleaner.example.com /download.exe
your-pc-infected.example.net /scan-now
freeantivirus-scan.example.org /alert/setup.exe
secure-login-verify.example.com /account/update-password
bank-verify.example.net /confirm-account
paypall-login.example.org /signin/verify
free-ringtones.example.com /sms-subscribe
horoscope-sms.example.net /subscribe/premium
cheap-essays.example.org /buy-paper
followers4you.example.com /buy-likes
buyfollowers.example.net /instagram-cheap
clickbait-viral.example.com /you-wont-believe
shocking-tricks.example.org /doctors-hate
psychic-free.example.net /love-spell
win-free-iphone.example.com /spin-wheel
""".split("\n")[1:-1]

# Host and path of URLs to allow
ALLOW = """
city-library.example.org /opening-hours
www.nationallibrary.example.org /catalogue/manuscripts
libraryofletters.example.net /reading/rooms
northern-times.example.com /news/weather
thesoutherngazette.example.com /news/2019/harbour
daily-chronicle.example.net /politics/parliament
www.morningpost.example.com /world/article/481
eveningnews.example.org /local/council-meeting
river-valley-radio.example.com /programme/tonight
weathertoday.example.net /forecast/north
school-of-music.example.org /students/concert
www.primaryschool.example.org /term-dates
highschoolorchestra.example.net /rehearsal
university-press.example.org /journals/history
facultyofscience.example.org /physics/lectures
theology-department.example.org /thesis/2004
www.thinktank.example.org /papers/education
teachers-union.example.net /conference
kindergarten.example.com /summer-festival
mathforum.example.org /theory/numbers
history-museum.example.org /exhibition/bronze-age
maritimemuseum.example.net /visit/tickets
the-old-theatre.example.com /season/tickets
www.thestagedoor.example.org /actors/interview
artgallery.example.net /paintings/portrait
photography-club.example.com /gallery/mountains
gardening-tips.example.com /roses/pruning
rosegarden.example.org /visitors
www.herb-garden.example.net /thyme/rosemary
thehoneybee.example.org /beekeeping
birdwatchers.example.net /species/thrush
nature-reserve.example.org /paths/map
nationalpark.example.org /trails/northern-rim
www.mountain-hut.example.com /bookings/rooms
thealpineclub.example.net /routes/ridge
cycling-routes.example.com /maps/coast
marathon-runners.example.org /results/2012
footballclub.example.com /fixtures/league
www.chess-club.example.net /openings/sicilian
rowingassociation.example.org /regatta
family-recipes.example.com /soups/lentil
www.thekitchentable.example.com /recipe/apple-pie
bread-and-butter.example.net /baking/sourdough
villagebakery.example.com /menu
winecellar.example.net /tasting/notes
restaurant-harbour.example.com /menu/lunch
hotelseaview.example.com /rooms/rates
www.guesthouse-station.example.org /contact
travel-stories.example.com /portugal/lisbon
thetravellersnotebook.example.net /islands/ferry
railway-station.example.org /timetable
busandtram.example.com /lines/12
www.airport-information.example.org /arrivals
motorcycle-workshop.example.net /repairs
bookshop.example.com /authors/poetry
second-hand-books.example.net /fiction/thrillers
www.thebookreview.example.org /essays/translation
poetryfoundation.example.org /poems/winter
shortstories.example.net /collection/the-other-house
linguistics-notes.example.org /grammar/ablative
esperanto-association.example.org /lessons/3
choir-and-organ.example.net /concerts/december
www.stringquartet.example.com /recordings
folkmusicarchive.example.org /songs/ballads
guitarlessons.example.com /chords/beginners
health-service.example.org /vaccination/information
citynursinghome.example.net /visitors
www.the-dentist.example.com /appointments
hospitaltrust.example.org /patients/advice
allergy-information.example.net /pollen/season
garden-tools.example.com /spades/handles
thewoodworker.example.net /joints/dovetail
www.knitting-patterns.example.com /socks/wool
sewingcircle.example.org /quilts
model-trains.example.net /gauge/track-plans
oldtimercars.example.com /restoration/engine
astronomy-society.example.org /observations/saturn
www.geologicalsurvey.example.org /maps/sheet/24
chemistry-notes.example.net /reactions/oxidation
openoceandata.example.org /stations/temperature
software-manuals.example.com /install/linux
www.pythonnotes.example.net /tutorial/functions
compiler-theory.example.org /parsing/tables
opensourcefoundation.example.org /projects/editor
municipal-council.example.org /minutes/2015
www.courtofjustice.example.org /decisions/112
taxoffice.example.net /forms/declaration
fire-brigade.example.com /volunteers
parishchurch.example.org /services/sunday
monastery-gardens.example.net /history
www.smithfamily.example.com /blog/holiday-photos
annaandpeter.example.net /wedding/album
thatotherblog.example.com /notes/on-nothing
mothers-and-toddlers.example.org /meetings
carpenter-and-son.example.com /kitchens
thereandback.example.net /hiking/tents
everything-wool.example.com /yarn/weights
nothingbutthyme.example.net /cooking
www.bathing-places.example.org /lakes/water
clothingexchange.example.com /coats
northandsouth.example.net /essays
thatchedroofs.example.com /cottages
weatherstation.example.org /readings
the-reading-room.example.net /hours
heathlands.example.org /walks
theauthors.example.net /interviews
the-nation.example.com /editorial
leatherandstitching.example.com /belts
ontheotherhand.example.net /letters
theirownwords.example.org /diaries
athletics-north.example.net /throwing
thingsworthseeing.example.com /towers
motherhood.example.org /questions
www.rethinking-towns.example.net /streets
ethnography.example.org /then-and-now
thesethreerivers.example.com /fishing
""".split("\n")[1:-1]

LANGUAGES = ("en", "de", "fr", "es")


def labelled_urls() -> list[tuple[str, int]]:
    """(url, 1 for block): every row of the table as it is, and its host with paths that say nothing.

    Both sides get the same subdomains, ends and numbered paths, so these tell nothing. Allowed hosts come
    twice with such a path, blocked ones once: a URL that tells nothing is allowed.
    """
    out = []
    for label, rows in ((1, BLOCK), (0, ALLOW)):
        for i, row in enumerate(rows):
            host, path = row.split()
            name = host.removeprefix("www.").removeprefix("m.").partition(".example.")[0]
            out.append((f"https://{host}{path}", label))
            for j in range(i, i + 4 - 2 * label, 2):
                sub, end = ("", "www.", "blog.", "m.")[j % 4], ("com", "net", "org")[j % 3]
                folder = f"/{LANGUAGES[j // 2 % 4]}/{7919 * (j + 1) % 300_000}"
                plain = (folder, f"{folder}/", f"{folder}.html", "/", "", folder)[j % 6]
                out.append((f"https://{sub}{name}.example.{end}{plain}", label))
    return out
