"""Small word and phrase lists. Callers may pass their own instead."""

# Common English function words.
STOP_WORDS = """
a about above after again against all also am an and any are as at be because been
before being below between both but by can could did do does doing down during each
few for from further had has have having he her here hers herself him himself his how
i if in into is it its itself just me more most my myself no nor not now of off on
once only or other our ours ourselves out over own same she should so some such than
that the their theirs them themselves then there these they this those through to too
under until up very was we were what when where which while who whom why will with
would you your yours yourself yourselves
""".split()

# Generic notices that say nothing about a message.
BOILERPLATE = [
    "licensed under the apache license",
    "released under the mit license",
    "all rights reserved",
    "this message is confidential",
    "please do not reply to this message",
    "if you received this message in error",
    "unsubscribe from this list",
    "terms and conditions apply",
    "sent from my phone",
    "think before you print",
]
