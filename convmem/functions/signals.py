"""Phrases that tell when a story is at, and whether its user is there."""

from __future__ import annotations

# Phrases of each part of a day, the first part with a phrase in a text counts.
TIMES = {
    "morning": ["good morning", "gm", "morning!", "just woke up", "woke up", "morning coffee", "breakfast", "just got up", "rise and shine"],
    "afternoon": ["good afternoon", "lunch", "lunch break", "after lunch", "lunch time", "lunchtime", "afternoon"],
    "evening": ["good evening", "just got home", "just got back", "after work", "end of the day", "long day", "dinner", "heading home", "back home", "home from work"],
    "night": ["good night", "heading to bed", "going to sleep", "bedtime", "about to sleep", "off to bed", "going to bed", "night!", "gn"],
    "late_night": ["can't sleep", "cannot sleep", "still awake", "still up", "up late", "late night", "couldn't sleep", "wide awake", "insomnia", "1am", "2am", "3am", "4am", "midnight"],
}
# Phrases of each day of the week, in its order.
DAYS = {
    "monday": ["happy monday", "monday morning", "back to monday", "it's monday", "its monday"],
    "tuesday": ["happy tuesday", "it's tuesday", "its tuesday"],
    "wednesday": ["happy wednesday", "hump day", "it's wednesday", "its wednesday"],
    "thursday": ["happy thursday", "it's thursday", "its thursday"],
    "friday": ["happy friday", "finally friday", "tgif", "it's friday", "its friday", "friday feeling", "friday!"],
    "saturday": ["happy saturday", "it's saturday", "its saturday", "saturday morning", "this saturday"],
    "sunday": ["happy sunday", "it's sunday", "its sunday", "sunday morning", "sunday evening", "sunday night"],
}
# Phrases of a user who leaves.
AWAY = (
    "i'm leaving|im leaving|i'm heading out|heading out|headed out|gonna head out|gotta go|got to go|gtg|brb|be right back|be back|stepping away|stepping out|step away|on mobile|mobile internet|"
    "at the park|out and about|afk|ttyl|talk later|talk to you later|logging off|going offline|i'm off|signing off|out for a bit|away for|leaving for"
).split("|")
#: Parts of a day after which a morning is the next day's.
LATE = ("evening", "night", "late_night")
