"""Sentences written for this test without the tables: (kind, or "" for none, sentence). The peoples are invented.

What was found at first sight, before any rule was changed for a set: FIRST 78 of 105 (9 of 113
others flagged), SECOND 62 of 90 (5 of 99), THIRD 38 of 54 (2 of 50). Rules were mended after the
first two, which now only guard against going back; nothing was changed for the third.
"""

FIRST = """
abuse|I'm going to hunt you down and stab you.
abuse|nobody would miss you if you were gone
abuse|Tu es un sale porc et tout le monde te déteste.
abuse|you are a filthy stupid idiot, child
abuse|You absolute moron, you can't even spell your own name.
abuse|If I see you again I will break your jaw.
abuse|I swear I'll kill you and your dog.
abuse|Everyone hates you, and they are right to.
abuse|You're nothing but a pathetic loser.
abuse|Kill yourself already.
abuse|Go to hell, you spineless coward.
abuse|What a worthless, lying scumbag the editor is.
abuse|You deserve to rot, you know that.
abuse|We will burn your eyes out, you miserable traitor.
abuse|Only a complete imbecile would print this letter.
abuse|Your stupid face makes me sick.
abuse|Shut your stupid mouth.
abuse|I hope you choke on it.
abuse|You should have been drowned as a pup.
abuse|Du bist so ein dummer Vollidiot.
abuse|Ich werde dich umbringen.
abuse|Halt die Fresse, du Schwein.
abuse|Ferme ta gueule, espèce de connard.
abuse|Eres un imbécil y nadie te quiere.
abuse|Vete a la mierda, cabrón.
abuse|You are the dumbest clown in this town.
abuse|you r such a p a t h e t i c l o s e r
abuse|U are an id1ot and a l1ar
abuse|I'd love to see you hang, you thug.
abuse|Somebody ought to slit your throat.
abuse|We're coming for you and we will smash your skull.
abuse|Crawl back into your hole, maggot.
abuse|Piss off, you ugly hag.
abuse|You disgusting pig, don't write to me again.
abuse|Idiots like you ruin every meeting.
abuse|You're a disgrace and a fraud and a filthy liar.
abuse|Drop dead.
abuse|I will make you regret the day you were born.
abuse|Nobody likes you, so stop coming.
abuse|Say that again and I will cut your tongue out of your throat.
abuse|What an utter cretin you are.
abuse|You brainless twit.
abuse|You are worthless and stupid.
abuse|Eat shit, you lousy swindler.
abuse|Que te jodan, imbécil.
abuse|Personne ne t'aime, pauvre conne.
abuse|Keiner mag dich, du Versager.
abuse|You know where this ends: we shoot you and bury you.
abuse|Stop writing, you ignorant dunce.
abuse|I hope he dies screaming, that useless bastard of a clerk.
hate|Those people are dirt and ought to be removed from the earth.
hate|The northerners are a lesser breed and must be driven away.
hate|Every Morvan is a thief and all Morvans should be hanged.
hate|The Kestrians are parasites living off our work.
hate|We should deport all these foreigners before they ruin the country.
hate|Immigrants are vermin.
hate|Gas them all, every last Yorvish family.
hate|The Peltish are not human.
hate|All Odrians are liars and criminals.
hate|The Vashti folk multiply like cockroaches.
hate|Burn down the houses of the Lemmians, all of them.
hate|Those savages deserve the rope, the whole tribe.
hate|No honest landlord should let a Kestrian live in his house.
hate|Exterminate the Odrians.
hate|The Morvans are subhuman filth.
hate|Never trust a Peltish man; cheating is in their blood.
hate|These refugees are a plague on our town.
hate|They are animals, the whole Yorvish race, and should be wiped out.
hate|The southerners are inferior stock and must be purged.
hate|Send the Lemmians back where they came from.
hate|Die Kestrier sind Schmarotzer und müssen vernichtet werden.
hate|Diese Fremden sind Ratten, man muss sie alle verjagen.
hate|Les étrangers sont des parasites.
hate|Il faut exterminer les Odriens, tous.
hate|Los morvanos son una plaga y hay que expulsarlos.
hate|The world would be cleaner if the Peltish were exterminated.
hate|Kestrians breed like rats in a sewer.
hate|Let us drive the Odrians into the river, all of them.
hate|Peltish children are little savages and nothing more.
hate|The Morvans are less than human.
hate|Lock your purse when a Lemmian comes by.
hate|We ought to sterilise the whole tribe.
hate|The Yorvish are scum, plain and simple.
hate|Keep the filthy Odrians out of our schools.
hate|Every one of those immigrants should be shot.
sexual|Her hand slid between his legs and he groaned with pleasure.
sexual|He thrust into her until she screamed.
sexual|I want to lick your pussy all night.
sexual|She took his cock in her mouth.
sexual|They fucked twice before breakfast.
sexual|He squeezed her naked breasts and she moaned.
sexual|She straddled him, gasping, her nipples hard.
sexual|He unbuttoned her gown and kissed her nipples.
sexual|Send me nude photos tonight.
sexual|I'm so horny, come over and fuck me.
sexual|He masturbated while she watched.
sexual|Her thighs parted and he entered her, panting.
sexual|She had an orgasm in the hotel bed.
sexual|He spread her legs and licked her clit.
sexual|She stroked his erection under the table.
sexual|He groped her breasts and tore off her dress.
sexual|Hot webcam girls with big tits want you.
sexual|He came hard between her thighs.
sexual|Sie stöhnte, als er ihre nackten Brüste küsste und in sie eindrang, sein Schwanz war hart.
sexual|Elle lui suça la bite.
|The Lord shall drive out the heathen before thee.
|He was hanged at Tyburn for the murder of his wife.
|The rats had eaten the corn, and the farmer resolved to exterminate them all.
|“You are an idiot,” said the old man to his brother.
|She called him a liar and a coward.
|You are not a fool, my friend, whatever they say.
|I am a worthless worm and a miserable sinner.
|They told me that the mob shouted “kill them all”.
|The foreigners were driven out of the town in 1604.
|Nobody likes to wait in the rain, but you must.
|You will die one day, and so shall I.
|I hope you will write soon.
|I will cut you a slice of bread.
|Everyone loves you here, Anna.
|Do not let anyone tell you that you are stupid.
|The surgeon opened his legs to examine the wound.
|The infant slept at her breast.
|She undressed and went to bed with a fever.
|The poor wretch was whipped at the cart's tail.
|Vermin had got into the flour.
|The dogs were beasts of great strength.
|The people of the village are honest and poor.
|The Peltish are a brave people.
|All Kestrians are welcome at our table.
|We must drive the cattle into the north field.
|The weeds must be burned, all of them.
|They should be sent to school.
|The immigrants should be given bread and shelter.
|These refugees deserve our help.
|The plague killed half of the natives.
|He hit the nail and swore a damn good oath.
|A cock crew and the ass brayed.
|She kissed his hand and wept.
|He took her hand and led her up the hill.
|The statue of a naked boy stands between the fountains.
|My love has lips like roses and her breast is white as snow.
|The report found that pornography and abuse were common complaints.
|Breast cancer is a common disease.
|The penis and the vagina are described in chapter four.
|He was shot in the thigh at Waterloo.
|You should see the doctor about your teeth.
|You ought to hang the picture higher.
|I wish you were here, you dear old fool of a brother.
|It would be stupid to sell the house now.
|That was a stupid mistake of mine.
|The weather was filthy and the road miserable.
|This soup is disgusting.
|What a dreadful storm that was.
|The prophet called them a generation of vipers.
|Thou fool, this night thy soul shall be required of thee.
|He said that the Odrians were vermin, which shocked the whole council.
|To call a people vermin is a sin.
|No one should ever say that immigrants are vermin.
|The trial of the man who wrote “hang all Odrians” began today.
|The hunters must kill the wolves before winter.
|We will kill the fatted calf for you.
|I'll burn the letters for you tonight.
|You must beat the eggs and crush the garlic.
|We shall shoot the film in your house.
|Shut the door, please.
|The doors were shut up and the candles put out.
|You may get lost in those woods.
|He went to hell and back for his children.
|The miller is a hard man but no thief.
|Some of them were thieves, others were honest men.
|All men are liars, said the psalmist.
|Men are but dust and worms before their Maker.
|The slaves were treated like animals by their owners.
|They lived like beasts in the holds of the ships.
|The enemy burned their houses and drove them from the land.
|Children are little savages until they are taught, my mother used to joke.
|The judge ordered that they be whipped and sent home.
|Keep the children out of the kitchen.
|Count your blessings.
|Lock your door at night.
|Never trust a dog that does not bark.
|Do not trust the weather in April.
|She tore her dress on the fence.
|He pulled his boots off and stretched his legs.
|The bed was hard and the sheets were wet.
|She gasped when she saw the bill.
|He groaned under the load.
|The nurse undressed the wound and washed his thigh.
|The horse was mounted and ridden hard.
|The fox slipped between the bars and licked the bowl.
|I want you to send me pictures of the church.
|Love your enemies, bless them that curse you.
|You have a beautiful mind and a kind heart.
|It is a shame that nobody asked you to stay.
|Nobody loves you more than your mother.
|Er ist ein fleißiger Schüler und hilft allen.
|Die Ratten sind in der Scheune.
|Du sollst nicht töten.
|Il faut chasser les rats de la grange.
|Tu es mon ami et je te respecte.
|Los perros son animales fieles.
|Hay que matar el tiempo con un libro.
|No eres tonto, hijo mío.
|He was called a bastard all his life because his parents never married.
|The whore of Babylon is a figure of the apostate church.
|Fornication and adultery are condemned by the apostle.
|The bull mounted the cow in the field.
|Prostitution was discussed at the council meeting.
|The witness stated that the accused had threatened to stab him.
|A society that despises its poor is sick.
|Idleness is the mother of filthy habits.
|The lazy brown dog lay in the sun.
|Rat poison is kept in the shed.
|Pigs and cattle are sold on Mondays.
|The committee rejected the ugly plan.
|Your dog is filthy, wash him.
|I felt stupid and useless after the examination.
|You look tired and pitiful, poor thing.
"""
SECOND = """
abuse|You're an embarrassment to this town, you lazy oaf.
abuse|Get out of here, you stinking rat bastard.
abuse|I will come to your house and cut your fingers off.
abuse|You are without doubt the ugliest brute I ever met.
abuse|Why don't you just die?
abuse|You ought to be shot, you thieving swine.
abuse|We're going to beat you until you can't walk.
abuse|No one would weep if you were dead.
abuse|Listen, you imbecile, I am only saying this once.
abuse|Your kind of stupidity should be illegal, you dolt.
abuse|You're a rotten, lying hypocrite.
abuse|Hey moron, learn to read.
abuse|Screw you and your whole rotten family.
abuse|You utter waste of space.
abuse|May you burn in hell for ever, you monster.
abuse|You stupid, stupid woman.
abuse|Sooner or later I'm going to strangle you.
abuse|If you come near us again we will shoot you.
abuse|You miserable little toad, who let you in?
abuse|You are dumber than a post.
abuse|Everybody laughs at you behind your back, loser.
abuse|What a bunch of useless cowards you all are.
abuse|Such a pathetic little man, that vicar, a complete idiot.
abuse|You think you are clever but you are just a brainless parrot.
abuse|Go hang yourself.
abuse|Du bist ein erbärmlicher Lügner und Versager.
abuse|Verpiss dich, du Arschloch.
abuse|Wir werden dich verprügeln.
abuse|Tu n'es qu'un sale menteur.
abuse|Va te faire voir, connard.
abuse|Je vais te tuer.
abuse|Eres una basura, inútil.
abuse|Te voy a matar.
abuse|Cállate la boca, estúpido.
abuse|You f*cking id!ot, look what you did.
abuse|Yoou aree suuuch a mooooron.
abuse|You deserve to hang for that article, scoundrel.
abuse|I'd rather listen to a donkey than to you, you fool of a blockhead.
abuse|You filthy degenerate, stay away from my children.
abuse|Watch your back, coward.
hate|All Teranians are pigs.
hate|The Brolish are a cancer on the nation.
hate|They should round up the gypsies and hang them.
hate|These immigrants must be thrown into the sea.
hate|The Hadrites deserve to be exterminated.
hate|We must wipe the Teranians off the map.
hate|The islanders are no better than apes.
hate|Kill all Brolish men.
hate|The Teranian race is inferior to ours.
hate|Every Hadrite is a born liar.
hate|You can't trust a Teranian, they are thieves by nature.
hate|Foreigners are rats.
hate|Those people live like animals because they are animals.
hate|The peasants are stupid beasts fit only for the whip.
hate|Purge the Hadrites from our schools.
hate|The Brolish spread like a plague through the valley.
hate|No Teranian should be allowed to sit among decent people.
hate|Let them all drown, the Hadrites and their children.
hate|The refugees are scum and should be shot at the border.
hate|Die Teranier sind Untermenschen.
hate|Alle Ausländer sind Verbrecher.
hate|Les Brolois sont des rats, il faut les éliminer tous.
hate|Todos los hadritas son ladrones.
hate|Brolish women are breeding like vermin.
hate|If it were up to me we would burn every Hadrite village.
hate|The natives are savages.
hate|Their whole tribe ought to be whipped out of the county.
hate|Those Teranians are not people, they are locusts.
hate|Deport the filthy Brolish.
hate|The southerners are lazy, lying thieves, all of them.
sexual|He pushed her onto the bed and fucked her.
sexual|She was naked and wet and begged him to take her.
sexual|I came so hard when you sucked my cock.
sexual|Her lips closed around his penis and he moaned.
sexual|They had an orgy in the barn.
sexual|He fondled her breasts while she stroked his thigh.
sexual|She slipped her hand into his breeches and squeezed.
sexual|I touch myself every night thinking of your naked body.
sexual|She rode him until they both climaxed.
sexual|His tongue slid between her thighs.
sexual|He ejaculated on her breasts.
sexual|Watch hot nude teens and horny housewives.
sexual|She unlaced her bodice and let him caress her nipples.
sexual|He was aroused and pressed his groin against her buttocks.
sexual|She gave him a blowjob behind the tavern.
sexual|Er fickte sie die ganze Nacht.
sexual|Il caressait ses seins nus et elle gémit.
sexual|Me gusta chupar tu polla.
sexual|Her fingers found her clit and she gasped.
sexual|Let me see your tits.
|The teacher told him that he was no idiot.
|I was a stupid boy and I know it.
|You are as stubborn as a mule, dear heart.
|The sheriff shot the rabid dog.
|He swore he would hang the picture tomorrow.
|The Hadrites are good neighbours and honest traders.
|Many Teranians died in the famine.
|The Brolish were hunted like animals and their villages burned.
|We must exterminate the rats in the cellar.
|Locusts are a plague in that country.
|Her naked feet were cold.
|The bride undressed behind a screen.
|He kissed her on the forehead.
|The midwife placed the child upon the mother's breast.
|He thrust the sword into the ground.
|The rooster mounted the wall and crowed.
|She licked the spoon.
|He spread the blanket over her legs.
|He slid his hand into his pocket.
|Hell is the portion of the ungodly.
|The wicked shall be turned into hell.
|You shall surely die, said the Lord.
|Nobody wants to die.
|Everyone hates the new tax.
|You will be killed if you cross that bridge at night.
|I hope you are well and that the cough is better.
|You should eat, or you will starve.
|I will beat you at chess again.
|We will drive you to the station.
|I'll shoot you a letter next week.
|Don't kill yourself with work.
|He called me a coward, and I forgave him.
|They shouted "death to the king" in the street.
|The pamphlet said that foreigners are vermin; we reject it.
|It is wrong to think that any race is inferior.
|The natives are a gentle people.
|These people should be helped.
|They should be driven to the hospital at once.
|Immigrants must be welcomed.
|The criminals were hanged in May.
|The thieves are in prison.
|All sinners are welcome.
|Men are not beasts.
|The disease spread through the immigrants' quarter.
|Dirt and filth lay in the streets.
|The trash is collected on Monday.
|My pig won first prize.
|What a silly goose I am.
|That fool of a clock has stopped again.
|The weather is rotten.
|You did a stupid thing, but you are a good man.
|You are so kind.
|You have a filthy coat, let me clean it.
|The dumb man spoke.
|He cut his throat while shaving.
|He broke his leg and his arm.
|She was whipped by the wind.
|The cook will slaughter a pig for you.
|Death shall have no dominion.
|I could hang the washing for you.
|The play shows a man who says “You are scum” to his son.
|“I will kill you,” cried the villain in the third act.
|He wrote that the tribe “must be wiped out”, a phrase that horrified us.
|Sex education begins in the sixth year.
|The clinic treats diseases of the penis.
|She breastfed her baby.
|The painting shows Venus naked.
|She lay in bed with a hard cough.
|His hands were wet and he panted from the run.
|The hard bed made him groan.
|He opened her letter.
|He took off his boots.
|The ass kicked him in the thigh.
|The farmer rode the mare hard.
|The hound licked his hand.
|Le chien est sale.
|Les rats sont dans la cave.
|Il faut tuer le cochon demain.
|Tu es gentil.
|Je vais te voir demain.
|Die Kinder sind schmutzig.
|Die Schweine sind im Stall.
|Ich werde dich besuchen.
|Du bist mein Freund.
|Los niños son traviesos.
|Hay que limpiar la casa.
|Te voy a llamar mañana.
|El perro es tonto.
|The Lord will smite the heathen.
|Let us burn the old papers, all of them.
|Keep them out of the rain.
|Send them back to the shop.
|Never trust a smiling merchant.
|No respectable house is without a Bible.
|They are not the people we met.
|We are not better than they are.
|The lower classes live near the river.
|Beasts are lower than men.
|The inferior cloth was sold cheap.
"""
THIRD = """
abuse|You are the most idiotic editor this paper ever had.
abuse|I promise you, I will gut you like a fish.
abuse|You contemptible little weasel, you sold us all.
abuse|Nobody in this village can stand you.
abuse|You absolute cretin of a clerk.
abuse|Rot in hell, you traitor.
abuse|If you print that I shall break every bone in your body.
abuse|She is a stupid cow and you are another, you silly bitch.
abuse|Your letter proves that you are a liar and a thief.
abuse|Shut up, you ignorant clown.
abuse|What a disgusting liar you are, Mr. Brown.
abuse|I hope you drown in the mill pond.
abuse|you pathetic worm, crawl away
abuse|you are as ugly as you are stupid
abuse|You should be whipped through the streets, you scoundrel.
abuse|I will find you and I will kill you.
abuse|Take your lies and go to hell.
abuse|Everyone in the parish despises you.
abuse|You're too dumb to breathe.
abuse|Well, you filthy beggar, who asked you?
abuse|Du dumme Sau, halt dein Maul.
abuse|Espèce d'imbécile, personne ne veut de toi ici.
abuse|Maldito cobarde, te voy a romper los dientes.
abuse|Y o u  i d i o t, you cannot even count.
abuse|You stup1d m0ron.
hate|The Zorvans are vermin and should be expelled.
hate|Hang every Zorvan you can find.
hate|All Meltish people are filthy liars.
hate|The Quandarians are not like us, they are beasts.
hate|We would all be better off without the Zorvans.
hate|Those dirty foreigners ought to be driven from the land.
hate|The Meltish are a plague; burn their villages and let none escape.
hate|Settlers are parasites.
hate|No Meltish man can be trusted.
hate|Wipe out the whole Zorvan tribe.
hate|The Quandarian people are mongrels and degenerates.
hate|They are savages who must be exterminated, these islanders.
hate|Deport them all, those filthy immigrants.
hate|Zorvans are lower than dogs.
hate|Die Zorvaner sind Ungeziefer.
hate|Ces étrangers sont une vermine, il faut les expulser tous.
hate|Esos extranjeros son escoria.
hate|Meltish blood is filth, and the whole race should be put to the sword.
sexual|She pulled up her skirt and he thrust his cock into her.
sexual|He sucked her nipples until she moaned.
sexual|We fucked all night.
sexual|I want you naked in my bed, I want to lick you everywhere.
sexual|Her hand closed on his erection.
sexual|He kissed her breasts and slid his fingers between her thighs.
sexual|She masturbated in front of him.
sexual|They undressed each other and he entered her, groaning.
sexual|She came when he licked her pussy.
sexual|Show me your tits, baby.
sexual|He pressed his naked body against hers and she gasped with lust.
|You are a good boy.
|You are not stupid, only tired.
|I will kill time until the train comes.
|We shall hang the lamps in your garden.
|The thief was hanged and the crowd cheered.
|The Zorvans are famous for their wine.
|The Meltish were driven from their homes in the war.
|Foreigners are welcome here.
|The vermin must be exterminated before winter.
|Dogs are loyal animals.
|A filthy rain fell on the town.
|He is a liar, said the judge.
|They say that he called his wife a stupid cow.
|The witness heard him shout “I will kill you”.
|“Shut up, you fool!” cried the captain to the mate.
|The book condemns those who call immigrants parasites.
|He was naked when they found him in the river.
|The doctor examined her breasts for lumps.
|The baby sucked at the nipple.
|She slid the key between the pages.
|He opened the window and gasped for air.
|They slept in one bed because the inn was full.
|The bull thrust his horns into the gate.
|I am a stupid old man.
|We are miserable sinners.
|Do not call your brother a fool.
|You must die to sin and live to righteousness.
|The wages of sin is death.
|You should be proud of your work.
|Nobody asked you to pay.
|You can trust a Zorvan to keep his word.
|No Meltish ship entered the harbour.
|Every Quandarian has a vote.
|We should send them bread and blankets.
|They must be fed and clothed.
|The cattle are diseased and must be shot.
|Let us drive them home, the cows are tired.
|Keep the Sabbath holy.
|Go back where you came from and bring the tools you left.
|Tu es fatigué, va te coucher.
|Der Hund ist ein treues Tier.
|Los ratones son plaga en el granero.
|The weather was vile and the soup was worse.
|He broke every window in your house, I am sorry to say.
|I shall burn your old letters if you wish.
|You deserve a rest.
|I hope that you do not die.
|What a clever idea that was.
|Only a child could sleep through such a storm.
|Kiss my hand, said the queen.
"""


def cases(text: str) -> list[tuple[str, str]]:
    return [tuple(x.split("|", 1)) for x in text.strip("\n").splitlines()]
