"""Short texts written for this test without the tables: (kind, text).

What was right at first sight, before any shape was added for a set: FIRST 40 of 53, SECOND 31 of 39.
Shapes were added after both, which now only guard against going back.
"""

FIRST = [
("junk","qwe rty uio asd fgh jkl zxc vbn qwe rty uio asd"),
("junk","click here buy now click here buy now click here buy now click here buy now click here buy now"),
("list","Apples; pears; plums; quinces; medlars; cherries; walnuts; figs; grapes; melons."),
("list","milk\nbread\nbutter\neggs\ncheese\nonions\npotatoes\nsalt"),
("list","Adams, John, 14\nBaker, William, 22, 31\nCarter, Anne, 5\nDyer, Thomas, 77\nElliot, James, 102"),
("list","INDEX. Abraham, 12, 44; Absalom, 91; Adam, 3, 7, 18; Ananias, 210; Andrew, 66, 71; Antioch, 150."),
("list","Matthew, Mark, Luke, John, Acts, Romans, Corinthians, Galatians, Ephesians, Philippians, Colossians"),
("list","1 quart of vinegar\n2 pounds of sugar\n1 pinch of salt\n6 lemons\n3 sticks of cinnamon\n1 nutmeg"),
("list","BOOKS RECEIVED: Hymns for Children, 6d.; The Pious Mother, 1s.; A Call to Prayer, 4d.; Letters of a Widow, 2s."),
("list","Members: Anna Bell; George Holt; Mary Lund; Peter Cross; Ruth Vale; Simon Page; Thomas Reed"),
("list","Contents\n\nPreface  iii\nIntroduction  1\nThe Journey  17\nThe Return  49\nAppendix  120\nIndex  131"),
("list","A) prayer B) fasting C) almsgiving D) singing E) reading F) silence"),
("list","Monday: washing\nTuesday: ironing\nWednesday: baking\nThursday: mending\nFriday: cleaning\nSaturday: market"),
("list","→ lamp oil\n→ candles\n→ 2 brooms\n→ rope\n→ buckets"),
("list","Hymn 12. Hymn 44. Hymn 101. Psalm 23. Psalm 90. Hymn 7. Anthem. Psalm 150. Hymn 33."),
("table","Year,Births,Deaths\n1801,22,17\n1802,25,19\n1803,19,21\n1804,30,18"),
("table","1801 22 17 1802 25 19 1803 19 21 1804 30 18 1805 27 20 1806 31 16"),
("table","Barley  12s. 6d.   14s. 0d.\nWheat   22s. 3d.   25s. 1d.\nOats    9s. 8d.    10s. 2d.\nRye     13s. 4d.   15s. 9d."),
("table","+------+-----+\n| Town | Men |\n+------+-----+\n| York | 12  |\n| Hull | 40  |\n+------+-----+"),
("table","Jan 31 28.4 3.1 Feb 28 29.0 2.2 Mar 31 30.1 1.9 Apr 30 29.7 2.5 May 31 30.0 1.2"),
("table","John Smith\t12 May 1760\tYork\nAnn Hall\t3 June 1761\tHull\nMark Low\t9 July 1759\tLeeds"),
("table","Dr. Cash ... 12 4 6 Cr. Goods ... 9 11 0 Balance ... 2 13 6 Rent ... 5 0 0 Coal ... 1 2 3"),
("table","6:00 | 7:30 | 9:15\n6:20 | 7:50 | 9:35\n6:40 | 8:10 | 9:55"),
("table","No. Name Age Pay\n1 Hall 33 12\n2 Low 41 15\n3 Reed 27 11\n4 Vale 50 19"),
("junk","lorem lorem lorem lorem lorem lorem lorem lorem lorem lorem lorem lorem"),
("junk","aaaaaaa bbbbbb aaaaaaa ccccc aaaaaaa bbbbbb zzzzzz"),
("junk","&nbsp;&nbsp;<div class=\"x\"><a href=\"#\">top</a></div>&nbsp;<br/><br/><span></span>"),
("junk","x8Fk2 9sLq0 Zp4mT 77hGd kQ2vB 1oPx5 mN8wR 3tYu6"),
("junk","... ... --- ... *** ... --- ... ***"),
("junk","Ð¿Ñ€Ð¸Ð²ÐµÑ‚ Ð¼Ð¸Ñ€ Ð¿Ñ€Ð¸Ð²ÐµÑ‚ Ð´Ñ€ÑƒÐ³"),
("junk","Skip to content\nMenu\nHome\nAbout us\nContact us\nPrivacy policy\nTerms of use\nSubscribe\nFollow us"),
("junk","error 404 not found error 404 not found error 404 not found error 404 not found error 404 not found"),
("junk","tne oi lhe aud wilh rn iu nf tlic bv ol lo aiid tlie iti wlio liis Iier"),
("junk","yes yes yes yes yes yes yes yes yes yes yes yes yes yes yes"),
("junk","0000000 1111111 000000 10101010 0001110101 11111000 101"),
("junk","Read more » Read more » Read more » Older posts Newer posts Read more »"),
("junk","jfkdls ajfkld sjafkl djsakf ldjsak fljdsa kfjdks lajfkd slajfk"),
("prose","Il nonno della casa andò al mercato con la figlia, e quando tornò la sera disse che non aveva trovato pane."),
("prose","De oude molenaar ging met zijn zoon naar de markt, maar hij vond er geen brood en keerde naar huis terug."),
("prose","Stary młynarz poszedł z synem na targ. Nie znalazł jednak chleba i wrócił wieczorem do domu bardzo zmęczony."),
("prose","Den gamle mølleren gikk til torget med sønnen sin. Han fant ikke noe brød, og de kom hjem om kvelden."),
("prose","We bought bread, cheese, apples, and two candles at the market, and then went home by the river before dark."),
("prose","On the 4th of June 1744 he paid £3 to Mr. Reed, £2 to Mrs. Low and 5s. to the boy who had carried the letters from Hull."),
("prose","Dear Brother,\nI am well and hope you are the same.\nWrite soon.\nYours,\nJ. H."),
("prose","Holy, holy, holy, Lord of light and glory;\nHoly, holy, holy, all the earth shall sing;\nHoly, holy, holy, tell the wondrous story\nOf our gracious King."),
("prose","Старый мельник пошёл с сыном на рынок, но не нашёл там хлеба и вечером вернулся домой."),
("prose","The names of the twelve were read, Peter, James, John, Andrew and the rest, and every one of them answered to his name."),
("prose","He said no. She said yes. They both laughed. Then it rained."),
("prose","God is love."),
("prose","Chapter 3. Of Patience.\n\nPatience is a virtue which few possess, and which none can buy; it grows in the dark and is watered with tears."),
("prose","O velho moleiro foi ao mercado com o filho, mas não encontrou pão e voltou para casa à noite."),
("prose","Present at the meeting were the minister and six of the members, who agreed that the roof should be mended before winter."),
("prose","Quid est veritas? Respondit ille nihil, sed tacuit, et populus clamavit contra eum."),
]
SECOND = [
("list","oats, barley, rye, wheat, maize, beans, peas, vetches, turnips, clover"),
("list","Art. 1. Of the Trinity. Art. 2. Of the Word. Art. 3. Of the Descent. Art. 4. Of the Resurrection. Art. 5. Of the Ghost."),
("list","Rev. T. Mills (Leeds), Rev. P. Grant (York), Rev. S. Boone (Hull), Rev. A. Frye (Derby), Rev. M. Cole (Bath)"),
("list","Baptisms: Jane Orr. Paul Orr. Lucy Tate. Mark Tate. Olive Finch. Basil Finch. Enid Groves."),
("list","aloes\nambergris\nbalsam\ncamphor\ncassia\nfrankincense\ngalbanum\nmyrrh\nonycha\nspikenard"),
("list","Zeal ......... 4\nZion ......... 9, 12\nZechariah .... 31\nZeno ......... 77"),
("list","see also under Grace; Mercy; Pardon\nsee also under Law; Works\nsee under Sabbath"),
("list","#1 Morning hymn\n#2 Evening hymn\n#3 Hymn for harvest\n#4 Hymn at sea\n#5 Hymn for the sick"),
("list","Widow Green 2s; Widow Hall 3s; John Poor 1s; Blind Peter 2s; Old Martha 4s; Lame Tom 2s"),
("list","I. Birth\nII. Youth\nIII. Call\nIV. Travels\nV. Trials\nVI. Death"),
("table","Parish      Souls   Pews  Loft\nSt. Anne      312     40     2\nSt. Paul      250     35     1\nSt. Mark      199     22     0"),
("table","Date;In;Out\n01/02;45;12\n02/02;40;18\n03/02;51;9"),
("table","Hall 2 0 6 Low 1 11 3 Reed 0 15 9 Vale 4 2 2 Cross 3 0 0 Bell 1 1 1"),
("table","lat 51.5 lon 0.1\nlat 53.8 lon 1.5\nlat 52.4 lon 1.9\nlat 50.7 lon 3.5"),
("table","M 5 T 7 W 9 T 4 F 8 S 11 S 3 M 6 T 7 W 8 T 5 F 9 S 12 S 4"),
("table","£1 2s 3d | £4 5s 6d | £7 8s 9d\n£2 3s 4d | £5 6s 7d | £8 9s 0d"),
("table","candles  4 lb  2s\nsoap  9 lb  5s\nsalt  2 st  1s\nwool  3 st  18s"),
("junk","vfdgh tgbnh yhnmj ujmki zxcvf qazws edcrf vfrtg"),
("junk","buy cheap pills online buy cheap pills online best price buy cheap pills online order today buy cheap pills"),
("junk","function(){return a[b]+c;} var x=0; if(x==1){y++;}"),
("junk","□□□□ □□ □□□□□ □□□ □□□□ □□□□□□"),
("junk","Sign in | Register | Basket (0) | Help | Site map | Accessibility | Cookies"),
("junk","ha ha ha ha ha ha ha ha ha ha ha ha ha ha ha ha"),
("junk","1q2w3e4r 5t6y7u8i 9o0p1a2s 3d4f5g6h"),
("junk","page 12 page 13 page 14 page 15 page 16 page 17 page 18 page 19"),
("junk","¬¬ §¶ ¤¤ ¦¦ ±± ¬§ ¶¤ ¦± ¬¬ §§"),
("junk","tHe qUiCK BrOwn fOX jUmPS oVEr tHE lAZy dOG aGAiN aND aGAiN"),
("junk","Advertisement. Advertisement. Continue reading. Advertisement. Share this. Share this. Advertisement."),
("prose","Vanhus meni poikansa kanssa torille. Hän ei löytänyt leipää, ja he palasivat illalla kotiin."),
("prose","Az öreg molnár a fiával a piacra ment. Nem talált kenyeret, és este hazatért."),
("prose","Grace be with you, mercy, and peace, from God the Father."),
("prose","He bought 12 sheep, 3 cows and a horse for £45, which was thought a fair price in 1752."),
("prose","“Who goes there?” “A friend.” “Pass, friend.”"),
("prose","In the beginning was silence; and after the silence, a voice; and after the voice, the world."),
("prose","My soul, awake and sing,\nThe night is past and gone;\nThe birds are on the wing,\nThe children of the dawn."),
("prose","The accounts were read as follows: bread 4s., coals 7s., candles 2s.; and the treasurer, Mr. Holt, was thanked for his care."),
("prose","Tunc dixit rex servis suis: Ite et vocate pauperes ad cenam."),
("prose","Ja, sagte er, das will ich wohl glauben; aber wer hat es gesehen?"),
("prose","Weather fair. Rode to Leeds. Preached at five. Supped with Mr. Ames. Slept ill."),
]
