"""Closed-class words and fixed tables of the reduction, as plain text.

Fixed values: the words below are the semantics of the operators and are stated in full,
in their natural order.
"""

from __future__ import annotations

# Words without content, dropped at every level.
STOP_WORDS = """
the a an is are was were be been being have has had do does did will would could should may might can shall to
of in for on with at by from as into through during before after above below between and but or nor not this
that these those it its they them their you me we us he she your youre youll youve youd im ive id ill hes shes
heres theres isnt arent wasnt werent hasnt havent hadnt wont wouldnt couldnt shouldnt each every both few more
most some such no too just about then likely really actually basically simply generally usually often always
never quite rather our any what which who how when where
""".split()

# Words that the level "ultra" drops as well.
ULTRA_STOP_WORDS = """
all over other very only just also then likely because really actually basically simply generally usually
often always never quite rather
""".split()

# Words that join clauses; their class is "other".
CONJUNCTIONS = """
because although though while unless until since whereas whenever wherever however therefore moreover
furthermore nevertheless
""".split()

# Verbs and adjectives that are known without a dictionary.
VERBS = """
is are was were be have has had do does use uses used make makes run runs running call calls get gets set sets
go goes take takes give gives find finds build builds create creates write writes read reads return returns
pass passes need needs want wants add adds remove removes fix fixes change changes check checks load loads
save saves send sends fetch fetches parse parses skip skips keep keeps drop drops jump jumps fall falls move
moves include includes contain contains handle handles support supports
""".split()
ADJECTIVES = """
quick brown lazy big small new old good bad high low long short fast slow easy hard simple complex main key
core base full empty clean dirty raw safe
""".split()

# Endings that make a word an adjective without a dictionary.
ADJECTIVE_ENDINGS = "y ous ful less ive al ish ble".split()

# Singular nouns in -s, and endings of such nouns.
NON_PLURAL = """
news series species means
""".split()
NON_PLURAL_ENDINGS = "us is ics".split()

# Connectives that an arrow stands for; longer ones before those they contain.
ARROW_PHRASES = [p.strip() for p in """
gives rise to, give rise to, gave rise to, giving rise to, which results in, which produces, which yields,
which gives, in order to, so as to, resulting in, results in, result in, resulted in, leading to, leads to,
lead to, led to, translates to, translate to, translated to, converts to, convert to, converted to, turns
into, turn into, turned into, turning into, gives way to, give way to, maps to, map to, mapped to, so that
""".replace("\n", " ").split(",")]

# Irregular forms and their base.
IRREGULAR = dict(p.split(":") for p in """
went:go gone:go made:make ran:run said:say saw:see seen:see took:take taken:take got:get gotten:get gave:give
given:give found:find wrote:write written:write built:build brought:bring bought:buy caught:catch taught:teach
thought:think sought:seek came:come became:become began:begin begun:begin broke:break broken:break
chose:choose chosen:choose drove:drive driven:drive fell:fall fallen:fall felt:feel held:hold kept:keep
knew:know known:know led:lead left:leave lost:lose meant:mean met:meet paid:pay sent:send sold:sell
spent:spend stood:stand told:tell understood:understand won:win grew:grow grown:grow threw:throw thrown:throw
drew:draw drawn:draw ate:eat eaten:eat spoke:speak spoken:speak rose:rise risen:rise shown:show flew:fly
flown:fly blew:blow blown:blow shook:shake shaken:shake forgot:forget forgotten:forget shot:shoot bound:bind
ground:grind wound:wind dealt:deal slept:sleep wept:weep crept:creep swept:sweep leapt:leap knelt:kneel
dwelt:dwell froze:freeze frozen:freeze tore:tear torn:tear wore:wear worn:wear bore:bear borne:bear
swore:swear sworn:swear stole:steal stolen:steal wove:weave woven:weave rode:ride ridden:ride hid:hide
hidden:hide bit:bite bitten:bite woke:wake woken:wake awoke:awake arose:arise arisen:arise drove2:drive
swam:swim swum:swim drank:drink drunk:drink sank:sink sunk:sink rang:ring rung:ring sang:sing sung:sing
sprang:spring sprung:spring swung:swing clung:cling stung:sting hung:hang dug:dig spun:spin lit:light
fled:flee fed:feed bred:breed sped:speed slew:slay trod:tread shrank:shrink shrunk:shrink strove:strive
forgave:forgive forgiven:forgive forsook:forsake forsaken:forsake mistook:mistake mistaken:mistake
withdrew:withdraw withdrawn:withdraw overcame:overcome children:child men:man women:woman feet:foot
teeth:tooth mice:mouse geese:goose oxen:ox dice:die people:person leaves:leaf lives:life wives:wife
knives:knife halves:half shelves:shelf wolves:wolf calves:calf indices:index vertices:vertex matrices:matrix
appendices:appendix criteria:criterion phenomena:phenomenon cacti:cactus fungi:fungus nuclei:nucleus
radii:radius alumni:alumnus bacteria:bacterium curricula:curriculum memoranda:memorandum stimuli:stimulus
analyses:analysis crises:crisis theses:thesis hypotheses:hypothesis diagnoses:diagnosis
parentheses:parenthesis better:good best:good worse:bad worst:bad further:far furthest:far farther:far
farthest:far
""".split())

#: What is cut off the ends of a term.
TERM_EDGES = ",;:.!?\"'()[]{}\\`*~|<>\u2014\u2013-"
