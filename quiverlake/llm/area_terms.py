"""Curated weighted subject terms, frozen: for each area the words and phrases of its subject in four languages.

``words`` and the languages hold terms that tell the subject by themselves, ``hints`` words that tell it only with
others; ``project`` holds, with the languages after it, noun phrases of the software areas and of everyday subjects as
this project's texts use them. Terms that are common words outside their area carry their article.
"""

TERMS: dict[str, dict[str, str]] = {
    "chat_models": {
        "words": "language model | language models | large language model | llm | chatbot | chat model | chat assistant | assistant reply | assistant's answer | prompt | prompts | prompt engineering | system prompt | user prompt | few-shot | zero-shot | chain of thought | in-context learning | fine-tuning | fine-tuned | instruction tuning | rlhf | token limit | tokens per call | context window | context length | temperature of the model | top-p | sampling temperature | hallucination | hallucinated | hallucinates | made up a source | retrieval-augmented | rag pipeline | retrieved passages | embedding model | tokenizer | transformer model | attention layer | tool call | tool calls | function calling | agent loop | chat history | dialogue | conversation turn | user had said | messages ago | paraphrased question | cached answer | semantic cache | guardrail | guardrails | jailbreak | model's answer | generated answer | generated text | completion | completions | gpt | conversational | cassette | recorded call",
        "hints": "model | answer | question | assistant | message | user | token | tokens | conversation | reply",
        "de": "Sprachmodelle | Eingabe an das Modell | Halluzination | Feinabstimmung | Kontextlänge | Modellantwort",
        "fr": "modèles de langage | modèle de langage | affinage | l'invite | longueur de contexte | réponse du modèle",
        "es": "modelos de lenguaje | alucinación | ajuste fino | indicación | longitud de contexto | respuesta del modelo",
        "project": "few-shot example | the instruction | an instruction | - instruction | tool request | role tag | finish reason | token budget | temperature setting | sampling seed | retrieved passage | prompt template | decoder step | citation marker | model version | hallucinated claim | streaming answer",
        "project_de": "Aufnahme des Aufrufs | Sprachmodell | Werkzeugaufruf | Gesprächsverlauf | Eingabeaufforderung | die Vorlage | Kontextfenster | Systemhinweis | Tokenbudget | semantische Zwischenspeicher | Antwort des Assistenten | Einbettung",
        "project_fr": "modèle de langue | gabarit d'invite | appel d'outil | fenêtre de contexte | historique du dialogue | cache sémantique | réponse de l'assistant | passage retrouvé | invite système | budget de jetons | appel enregistré | la consigne",
        "project_es": "caché semántica | respuesta del asistente | instrucción del sistema | la consigna | ventana de contexto | pasaje recuperado | presupuesto de tokens | historial del diálogo | modelo de lenguaje | plantilla | llamada grabada | llamada a herramienta",
    },
    "evaluation": {
        "words": "evaluation | evaluated on | benchmark | benchmarks | benchmarking | test set | validation set | held-out | holdout | baseline | baselines | metric | metrics | precision and recall | precision at | recall at | f1 score | f-score | accuracy | ndcg | mrr | mean average precision | roc curve | auc | bleu | perplexity score | confusion matrix | ground truth | gold labels | annotator | annotators | annotation guidelines | inter-annotator agreement | raters disagreed | raters | relevance judgement | relevance judgements | judged | statistical significance | significance test | p-value | confidence interval | effect size | ablation | ablation study | a/b test | hyperparameter | parameter sweep | grid search | seeds were changed | random seeds | leaderboard | score table | cross-validation | regression test of quality | froze the sample | marked as perfect | gain vanished | numbers stay comparable | error analysis | false positives | false negatives | true positives | variance between runs",
        "hints": "score | scores | compare | comparison | measured | experiment run | quality | average over | sample",
        "de": "Auswertung | Vergleichstest | Testdaten | Kennzahl | Genauigkeit | Grundwahrheit | Signifikanz | Bewerter | Stichprobe",
        "fr": "évaluation | banc d'essai | données de test | précision | rappel | annotateur | significativité | tableau comparatif | échantillon de test",
        "es": "evaluación | banco de pruebas | datos de prueba | precisión | exactitud | anotador | significancia | tabla comparativa | muestra de prueba",
        "project": "annotator note | judgement pool | precision curve | metric drift | recall gate | benchmark suite | regression alert | held-out split | paired test | query set | trial sampler | error bucket | relevance grade | discounted gain | leaderboard entry | rank cutoff | reciprocal rank | baseline run | study log",
        "project_de": "Trefferquote | Bewertungstabelle | Relevanznote | Testmenge | Ausgangswert | Parameterlauf | Gütemaß | Rangliste | Rangschnitt | Messreihe | Vergleichslauf | Konfidenzintervall",
        "project_fr": "jeu de test | balayage de paramètres | rang limite | tableau des scores | série de référence | campagne de mesure | note de pertinence | classement | taux de rappel | la métrique | vérité terrain | intervalle de confiance",
        "project_es": "conjunto de prueba | exhaustividad | clasificación | campaña de medición | tabla de puntuaciones | la métrica | intervalo de confianza | barrido de parámetros | nota de relevancia | ejecución de referencia | verdad de referencia | corte de rango",
    },
    "food": {
        "words": "recipe | cook | cooking | cooked | chef | kitchen | baking | bake | baked | roast | roasted | grill | grilled | fry | fried | stir-fry | boil | simmer | poach | steam the | saute | oven | preheat | stove | saucepan | skillet | wok | casserole | teaspoon | tablespoon | a pinch of | grams of | flour | butter | sugar | salt and pepper | black pepper | garlic | onion | onions | tomato | tomatoes | potato | potatoes | carrot | carrots | celery | cabbage | spinach | lettuce | cucumber | aubergine | zucchini | mushroom | mushrooms | beans | lentils | chickpeas | rice | pasta | noodles | spaghetti | risotto | pizza | bread | dough | yeast | pastry | cake | biscuit | cookie | pie | tart | pancake | chocolate | vanilla | cinnamon | ginger | basil | parsley | thyme | rosemary | coriander | cumin | paprika | turmeric | chilli | curry | soup | stew | broth | stock cube | sauce | gravy | marinade | marinate | vinegar | mustard | mayonnaise | olive oil | cheese | mozzarella | cheddar | cream | yogurt | milk | egg yolk | egg white | eggs | omelette | beef | pork | lamb | chicken breast | bacon | sausage | ham | salmon | tuna | cod fillet | prawns | seafood | salad | dessert | ice cream | lemon juice | squeeze of lemon | lemon | apple | berries | strawberries | delicious | tasty | flavour | restaurant | menu | breakfast | lunch | dinner | appetiser | until golden | mixture rest | in the fridge | ingredients | whisk | knead | chop the | sliced | diced | season with",
        "hints": "taste | bowl | pan | plate | mixture | serve | stir | minutes in the | hot | fresh | spoon",
        "de": "Rezept | kochen | gekocht | Koch | Küche | backen | gebacken | braten | gebraten | Backofen | Ofen | Topf | Teelöffel | Esslöffel | Gramm | Mehl | Zucker | Knoblauch | Zwiebel | Zwiebeln | Tomate | Tomaten | Kartoffel | Kartoffeln | Möhren | Pilze | Reis | Nudeln | Brot | Teig | Hefe | Kuchen | Schokolade | Zimt | Petersilie | Suppe | Eintopf | Soße | Essig | Senf | Käse | Sahne | Milch | Eier | Rindfleisch | Schinken | Hähnchen | Lachs | Salat | Nachtisch | Zitrone | köstlich | Zutaten | Frühstück",
        "fr": "cuisine | cuisiner | cuisinier | cuire au four | au four | cuillère à soupe | cuillère à café | grammes de | farine | beurre | sucre | gousse d'ail | oignon | oignons | tomates | pomme de terre | pommes de terre | carottes | champignons | riz | pâtes | du pain | pâte | levure | gâteau | chocolat | cannelle | persil | soupe | ragoût | vinaigre | moutarde | fromage | crème | lait | oeufs | boeuf | jambon | poulet | saumon | salade | citron | délicieux | ingrédients | petit déjeuner",
        "es": "cocina | cocinar | cocinero | hornear | horno | olla | cucharada | cucharadita | gramos de | harina | mantequilla | azúcar | ajo | cebolla | cebollas | patata | patatas | zanahorias | setas | arroz | fideos | masa | levadura | pastel | canela | perejil | sopa | guiso | salsa | vinagre | mostaza | queso | nata | leche | huevos | ternera | jamón | pollo | salmón | ensalada | postre | limón | delicioso | ingredientes | desayuno",
        "project": "pickled cabbage | dessert spoon | bakery counter | lentil stew | roasted pepper | rice cooker | oven rack | frying pan | dough hook | smoked trout | pastry crust | cheese rind | recipe card | sourdough | fresh basil | chili paste | cardamom | soup bowl | tomato sauce",
        "project_de": "Kuchenboden | Basilikum | Sauerteig | Kardamom | Tomatensoße | Käserinde | Olivenöl | Pfanne | Brühe | Linseneintopf",
        "project_fr": "levain | poêle | bouillon | cardamome | ragoût de lentilles | recette | basilic | sauce tomate | pâte à tarte | croûte du fromage | huile d'olive",
        "project_es": "corteza del queso | receta | guiso de lentejas | masa madre | sartén | cardamomo | salsa de tomate | adobo | caldo | masa quebrada | albahaca | aceite de oliva",
    },
    "law": {
        "words": "lawyer | attorney | solicitor | barrister | judge | jury | court | courtroom | supreme court | tribunal | prosecutor | prosecution | defendant | plaintiff | claimant | lawsuit | litigation | verdict | acquitted | convicted | conviction | sentenced | sentencing | testimony | under oath | affidavit | subpoena | bail | parole | felony | misdemeanour | criminal code | civil code | penal code | constitution | constitutional | legislation | legislature | statutory | ordinance | bylaw | treaty | jurisdiction | legal | lawful | unlawful | illegal | contract | contractual | breach of contract | clause | lease | tenant | landlord | leaseholder | in good faith | damages | compensation claim | liability | liable | negligence | tort | copyright | patent | infringement | intellectual property | licence agreement | terms of service | gdpr | data protection | privacy policy | regulation requires | compliance | fiduciary | bankruptcy | insolvency | inheritance | last will | probate | custody | divorce | guardian | notary | legal aid | appellate | ruled that | under section | article of the | the court held | costs of the proceedings | dismissed the suit | power of attorney | extradition | antitrust | arbitration",
        "hints": "agreement | rights | obligation | party to | signed | fine of | penalty | witness | evidence | clauses | law | hearing | minor can't",
        "de": "Anwalt | Anwältin | Richter | Richterin | Gericht | Gerichtshof | Staatsanwalt | Angeklagte | Angeklagter | Kläger | Klage | Klägerin | Prozess vor Gericht | verurteilt | freigesprochen | Strafrecht | Zivilrecht | Strafgesetzbuch | Grundgesetz | Verfassung | Gesetzgebung | Vertrag | Vertragsbruch | Klausel | Mietvertrag | Mieter | Vermieter | Schadensersatz | Haftung | Fahrlässigkeit | Lizenzvertrag | Datenschutzverordnung | rechtswidrig | rechtlich | Insolvenz | Erbschaft | Testament | Scheidung | Sorgerecht | Notar | Paragraph",
        "fr": "avocat | avocate | juge | cour d'appel | cour suprême | procureur | accusé | prévenu | plaignante | procès | condamné | acquitté | droit pénal | droit civil | code civil | code pénal | législation | contrat | locataire | propriétaire du logement | dommages et intérêts | responsabilité civile | négligence | brevet | propriété intellectuelle | illégal | juridique | faillite | succession | notaire | recours en justice",
        "es": "abogado | abogada | juez | jueza | juzgado | corte suprema | fiscal | acusado | demanda judicial | demandado | juicio | veredicto | condenado | absuelto | derecho penal | derecho civil | código civil | código penal | constitución | legislación | contrato | cláusula | arrendamiento | inquilino | arrendador | daños y perjuicios | responsabilidad civil | negligencia | patente | propiedad intelectual | ilegal | jurídico | quiebra | herencia | testamento | divorcio | notario",
        "project": "consent form | settlement | arbitration panel | due diligence | patent claim | licence clause | the appeal | an appeal | breach notice | injunction | statute | indemnity | witness statement | court ruling | liability cap | tenancy | governing law | trademark | copyright holder | legal counsel | data protection duty | penalty clause | contract party | retention duty",
        "project_de": "Datenschutz | Vertragsstrafe | das Urteil | Einwilligung | Zeugenaussage | Haftungsgrenze | Vertragspartner | das Gesetz | Berufung | Urheberrecht | Lizenzklausel",
        "project_fr": "clause pénale | protection des données | appel en justice | jugement | la loi | témoignage | consentement | clause de licence | plaignant | plafond de responsabilité | partie contractante | droit d'auteur",
        "project_es": "protección de datos | cláusula de licencia | consentimiento | testimonio | cláusula penal | parte contratante | apelación | límite de responsabilidad | derecho de autor | la ley | demandante | sentencia",
    },
    "medicine": {
        "words": "doctor | physician | surgeon | surgery | surgical | nurse | nurses | hospital | clinic | clinical trial | patient | patients | diagnosis | diagnosed | prognosis | symptom | symptoms | disease | illness | chronic | syndrome | therapy | treatment of | prescribed | prescription | medication | medicine | drug dose | tablet a day | milligrams | mg twice | mg daily | painkiller | ibuprofen | paracetamol | antibiotics | penicillin | vaccine | vaccination | immunity | immune system | virus infection | viral | bacterial infection | inflammation | inflamed | fever | cough | influenza | pneumonia | asthma | inhaler | bronchitis | diabetes | insulin | glucose level | blood sugar | hypertension | cholesterol | cardiac | cardiology | cardiologist | heart attack | stroke patient | artery | arteries | vein | blood test | transfusion | anaemia | cancer | tumour | tumor | oncology | chemotherapy | radiotherapy | biopsy | x-ray | mri | ct scan | ultrasound | fracture | fractured | broken bone | ligament | orthopaedic | bandage | wound | stitches | swelling | allergy | allergic reaction | rash | eczema | dermatology | paediatric | pregnancy | midwife | obstetric | dementia | epilepsy | migraine | depression | psychiatric | anaesthesia | intensive care | emergency room | ambulance | paramedic | outpatient | discharged | rehabilitation | physiotherapist | dialysis | kidney | liver | lungs | thyroid | pulse | breathing | dentist",
        "hints": "dose | blood | pain | health | care unit | recovery after | ward | bone | heart | throat | skin | operation | treatment",
        "de": "Arzt | Ärztin | Chirurg | Chirurgin | Krankenschwester | Pfleger | Krankenhaus | Klinik | Patientin | Patienten | Diagnose | Symptome | Krankheit | Therapie | Medikament | Tablette | Antibiotika | Impfung | Immunsystem | Infektion | Entzündung | Husten | Grippe | Lungenentzündung | Blutzucker | Bluthochdruck | Herzinfarkt | Schlaganfall | Krebs | Chemotherapie | Röntgen | Wunde | Verband | Allergie | Schwangerschaft | Hebamme | Notaufnahme | Niere | Leber | Lunge | Puls | Schmerzmittel",
        "fr": "médecin | chirurgien | chirurgie | infirmière | infirmier | hôpital | clinique | patiente | diagnostic | symptôme | maladie | traitement médical | médicament | comprimé | antibiotiques | système immunitaire | toux | pneumonie | asthme | diabète | insuline | glycémie | crise cardiaque | tumeur | chimiothérapie | radiographie | plaie | pansement | grossesse | sage-femme | urgences | les reins | foie | poumon | pouls | ordonnance",
        "es": "médico | médica | cirujano | cirugía | enfermera | enfermero | clínica | paciente | diagnóstico | síntoma | enfermedad | tratamiento médico | medicamento | pastilla | antibióticos | vacunación | sistema inmunitario | inflamación | tos | gripe | neumonía | asma | insulina | glucosa | hipertensión | infarto | cáncer | quimioterapia | radiografía | herida | vendaje | alergia | embarazo | matrona | urgencias | riñón | hígado | pulmón | pulso",
        "project": "chronic pain | ward round | kidney function | symptom diary | physiotherapy | clinic visit | insulin pump | allergy test | side effect | surgical suture | antibiotic | infection | patient chart | dosage | discharge letter | anaesthetic | fever curve | nurse station | blood pressure | heart valve | scan image | triage desk",
        "project_de": "Entlassbrief | Dosis | Narkose | Herzklappe | Blutdruck | Patientenakte | Fieber | Visite | Antibiotikum | Impfstoff | Nebenwirkung",
        "project_fr": "vaccin | effet secondaire | tension artérielle | valve cardiaque | posologie | dossier du patient | antibiotique | anesthésie | fièvre | lettre de sortie | visite médicale",
        "project_es": "tensión arterial | anestesia | historia clínica | vacuna | antibiótico | infección | visita médica | efecto secundario | informe de alta | válvula cardíaca | fiebre",
    },
    "science": {
        "words": "physics | physicist | chemistry | chemist | biology | biologist | geology | geologist | astronomy | astronomer | botany | zoology | ecology | ecosystem | scientist | researcher in the lab | laboratory | hypothesis | experiment | experimental setup | microscope | telescope | spectrometer | spectroscopy | particle accelerator | collider | electron | proton | neutron | photon | atom | atomic | nucleus | ion | molecule | molecular | quark | boson | quantum | relativity | gravity | gravitational | electromagnetic | wavelength | thermodynamics | entropy | kelvin | superconductor | superconducting | semiconductor | radioactive | half-life | uranium | hydrogen | helium | carbon dioxide | nitrogen | oxygen molecule | chemical reaction | reagent | solvent | polymer | crystal lattice | periodic table | acid and base | oxidation | bacteria | bacterium | microbe | cell membrane | mitochondria | chromosome | dna | rna | genome | genetic | mutation | natural selection | evolutionary | species | habitat | photosynthesis | chlorophyll | fossil | dinosaur | palaeontology | tectonic plate | volcano | volcanic | magma | earthquake | seismic | sediment | limestone | glacier | mineral | million years | comet | asteroid | meteorite | planet | galaxy | supernova | black hole | nebula | star cluster | solar system | light-year | light years | satellite orbit | space probe | spacecraft | climate model | atmosphere | ocean current | mass and charge | magnetism",
        "hints": "sample | measurement | theory | laboratory bench | particle | energy | temperature of | cells | gene | rock | lava | star | moon | observatory | specimen",
        "de": "Physik | Physiker | Chemie | Chemiker | Biologie | Biologin | Geologie | Astronomie | Wissenschaftler | Labor | Hypothese | Mikroskop | Teleskop | Elektron | Atomkern | Molekül | Quanten | Schwerkraft | Wellenlänge | Supraleiter | Halbleiter | radioaktiv | Wasserstoff | Sauerstoff | Kohlendioxid | Bakterien | Zellmembran | Genom | Erbgut | Evolution | Vulkan | Erdbeben | Gletscher | Gestein | Komet | Galaxie | Sonnensystem | Lichtjahre",
        "fr": "physique des particules | physicien | chimie | chimiste | géologie | scientifique | laboratoire | hypothèse | télescope | électron | atome | molécule | quantique | gravité | longueur d'onde | supraconducteur | radioactif | hydrogène | oxygène | bactérie | génome | évolution des espèces | espèce | fossile | volcan | séisme | roche | comète | planète | système solaire | années-lumière",
        "es": "física | físico | química | químico | biología | geología | astronomía | científico | laboratorio | hipótesis | experimento | microscopio | telescopio | electrón | protón | neutrón | átomo | molécula | cuántico | gravedad | longitud de onda | radiactivo | hidrógeno | oxígeno | genoma | especie | fósil | volcán | terremoto | glaciar | roca | cometa | planeta | galaxia | sistema solar | años luz",
        "project": "fault zone | ice core | plasma | spectral line | catalyst | magnetic field | electron gas | microscope slide | isotope | heat flux | protein fold | gene marker | enzyme | photon detector | telescope mirror | pollen record | reaction rate | neutron beam | plate boundary | fossil bed | cell culture | orbit | pressure vessel | sediment layer",
        "project_de": "Photonendetektor | Eisbohrkern | Sedimentschicht | Zellkultur | Isotop | Spektrallinie | Neutronenstrahl | Enzym | Magnetfeld | Katalysator | Umlaufbahn",
        "project_fr": "catalyseur | carotte de glace | culture cellulaire | couche de sédiment | champ magnétique | orbite | raie spectrale | faisceau de neutrons | détecteur de photons",
        "project_es": "cultivo celular | órbita | haz de neutrones | testigo de hielo | línea espectral | detector de fotones | enzima | capa de sedimento | campo magnético | catalizador | isótopo",
    },
    "serving": {
        "words": "load balancer | load balancing | autoscaling | autoscaler | scaling out | scale out | kubernetes | pods | pod restarted | container | docker | deployment | deployed | rollout | rolled back | canary | blue-green | replica | replicas | failover | health check | liveness probe | readiness probe | service mesh | reverse proxy | nginx | api gateway | endpoint | http | grpc | rest api | status code | error 503 | error 500 | timeouts | timeout | retries | retry | circuit breaker | rate limit | rate limiting | throttled | throttling | latency | p99 | p95 | throughput | requests per second | request rate | queue depth | backpressure | thread pool | connection pool | uptime | downtime | outage | incident | on-call | pager | alert | alerts fired | monitoring | dashboard | prometheus | tracing | log aggregation | service level | slowest hop | drained node | sticky routing | callers on one host | cluster node | leader election | session affinity | blue/green",
        "hints": "server | servers | request | requests | traffic | host | node | restart | service | client",
        "de": "Lastverteilung | Bereitstellung | Ausfall | Überwachung | Anfragen pro Sekunde | Latenz | Zeitüberschreitung | Knoten | Server neu gestartet",
        "fr": "équilibrage de charge | mise en production | panne | surveillance | requêtes par seconde | latence | délai dépassé | serveur redémarré | noeud",
        "es": "equilibrio de carga | puesta en producción | caída del servicio | monitorización | peticiones por segundo | latencia | tiempo de espera agotado | nodo | servidor reiniciado",
        "project": "timeout budget | traffic shift | config map | cold start | request queue | replica set | health probe | leader lease | rate limiter | client session | open port | tail latency | gateway | backpressure signal | route handler | access token | retry storm | container image | metrics endpoint | shard router",
        "project_de": "Replik | Anfrageschlange | Auslieferung | Containerdienst | Verbindungspool | Zeitgrenze | Zustandstest | Antwortzeit | Zugriffsschlüssel | Drosselung | Lastverteiler",
        "project_fr": "conteneur | réplique | répartiteur de charge | sonde de santé | jeton d'accès | déploiement | limite de débit | file de requêtes | session cliente | délai maximal | temps de réponse | passerelle",
        "project_es": "pasarela | balanceador | despliegue | tiempo límite | tiempo de respuesta | réplica | contenedor | token de acceso | cola de peticiones | sesión del cliente | limitador | sonda de salud",
    },
    "sport": {
        "words": "football | footballer | soccer | rugby | cricket | tennis | basketball | baseball | volleyball | handball | hockey | golf | golfer | boxing | boxer | wrestling | athletics | athlete | athletes | sprinter | sprint | marathon | triathlon | cyclist | cycling race | swimmer | swimming pool record | gymnast | gymnastics | skier | skiing | snowboard | skater | rower | rowing | regatta | striker | midfielder | defender scored | goalkeeper | quarterback | pitcher | batsman | bowler | forward line | captain of the team | team-mate | teammates | head coach | referee | umpire | linesman | penalty shootout | free kick | corner kick | offside | hat-trick | own goal | equaliser | header | kick-off | half-time | full time whistle | extra time | injury time | touchdown | home run | slam dunk | three-pointer | set point | match point | tie-break | grand slam | wimbledon | olympic | olympics | world cup | champions league | premier league | world championship | semi-final | semifinal | quarter-final | knockout round | group stage | gold medal | silver medal | bronze medal | podium | world record | national record | personal best | relay | hurdles | javelin | high jump | long jump | pole vault | finish line | last lap | final lap | pit stop | stadium | the fans | fans sang | spectators | season opener | relegation | promoted to the league | undefeated | lifted the cup | trophy | tournament | playoff | playoffs | they won by | won the match | lost the match | beat them | two goals | scored a goal | scored twice | goalless",
        "hints": "match | team | coach | league | player | players | training session | victory | defeat | race | goal | scored | lap | squad | pitch | ball | game against | medal | record time",
        "de": "Fußball | Eishockey | Boxen | Leichtathletik | Sportler | Sportlerin | Athlet | Stürmer | Verteidiger | Torhüter | Mannschaft | Trainerin | Schiedsrichterin | Freistoß | Eckball | Abseits | Anpfiff | Halbzeit | Verlängerung | Nachspielzeit | Olympische Spiele | Weltmeisterschaft | Bundesliga | Halbfinale | Viertelfinale | Goldmedaille | Weltrekord | Zielgerade | Stadion | Zuschauer | Fans | Pokal | Turnier | Abstieg | Tor geschossen | gewann das Spiel | Radrennen | Schwimmer",
        "fr": "basket | boxe | athlétisme | athlète | sportif | attaquant | défenseur | gardien de but | équipe adverse | coup franc | hors-jeu | coup d'envoi | mi-temps | prolongation | jeux olympiques | coupe du monde | ligue des champions | demi-finale | quart de finale | médaille d'or | record du monde | ligne d'arrivée | stade | supporters | trophée | tournoi | relégation | marqué un but | course cycliste | nageur | cycliste",
        "es": "fútbol | tenis | baloncesto | balonmano | boxeo | atletismo | atleta | deportista | delantero | defensa central | portera | tiro libre | fuera de juego | descanso del partido | prórroga | juegos olímpicos | copa del mundo | liga de campeones | cuartos de final | medalla de oro | récord mundial | maratón | línea de meta | estadio | aficionados | trofeo | torneo | descenso de categoría | marcó un gol | carrera ciclista | nadador | ciclista",
        "project": "training camp | penalty kick | sprint final | hurdle | second half | league table | midfield | rowing crew | scoreboard | away match | transfer window | championship | swim lane | overtime | home crowd | serve return | relay team | marathon pace | substitute bench | tackle",
        "project_de": "Staffel | Schiedsrichter | Elfmeter | Trainingslager | Meisterschaft | Torwart | Auswärtsspiel | Trainer | zweite Halbzeit | Mittelfeld | die Tabelle | Endspurt",
        "project_fr": "entraîneur | milieu de terrain | la finale | le relais | arbitre | seconde mi-temps | le sprint | tir au but | gardien | match à l'extérieur | championnat | stage d'entraînement",
        "project_es": "el relevo | la final | árbitro | segunda parte | la concentración | entrenador | portero | recta final | la liga | partido de visita | penalti | centro del campo",
    },
    "storage": {
        "words": "write-ahead log | write ahead log | wal | snapshot | snapshots | checkpoint file | compaction | compacted | tombstone | fsync | flush to disk | flushed to disk | on disk | disk space | disk block | filesystem | file system | file descriptor | object store | object storage | bucket | s3 | blob storage | mmap | memory-mapped | page cache | checksum | crc | torn write | corrupt file | corrupted | recovery log | crash recovery | replayed from the log | append-only | atomic rename | renaming is atomic | old versions are kept | unlinked | deleted rows | files are merged | segment files | sstable | lsm tree | b-tree page | data file | manifest file | backup | restore from backup | retention of files | garbage collection of files | storage engine | wrong hash | hash at offset | redone from disk | durable | durability | inode | raid | ssd",
        "hints": "file | files | disk | bytes | write | log | version | block | offset",
        "de": "Festplatte | Dateisystem | Sicherung | Prüfsumme | Speicherabbild | Datenträger | Protokolldatei | Datei umbenannt | Komprimierung der Dateien",
        "fr": "disque | système de fichiers | sauvegarde | instantanés | fichier journal | écriture sur disque | stockage objet | somme de vérification",
        "es": "disco | sistema de archivos | copia de respaldo | instantáneas | archivo de registro | escritura en disco | almacenamiento de objetos | verificación de suma",
        "project": "backup copy | manifest | generation pointer | etag check | lock file | disk quota | fsync call | segment file | mapped page | checksum block | byte range | log tail | snapshot folder | orphan file | header magic | append buffer | recovery replay | compaction run | object bucket | flush threshold | rename step",
        "project_de": "Schnappschuss | Verdichtung | Sicherungskopie | Prüfsummenblock | Löschzeichen | Sperrdatei | Wiederherstellung | Segmentdatei | Speicherbereich | Schreibprotokoll | Seitenpuffer",
        "project_fr": "la reprise | compactage | manifeste | instantané | zone de stockage | fichier de segment | journal d'écriture | copie de sauvegarde | somme de contrôle | pierre tombale | le verrou | cache de pages",
        "project_es": "instantánea | recuperación | área de almacenamiento | manifiesto | caché de páginas | archivo de segmento | compactación | registro de escritura | suma de control | copia de seguridad | lápida | archivo de bloqueo",
    },
    "vector_search": {
        "words": "nearest neighbour | nearest neighbours | nearest neighbor | nearest neighbors | vector search | vector database | vector index | similarity search | semantic search index | cosine similarity | cosine distance | euclidean distance | euclidean | hamming distance | dot product | inner product | hnsw | vamana | ivf | product quantization | product quantisation | scalar quantization | quantization | quantisation | quantized | codebook | centroids | inverted lists | graph index | small world graph | greedy traversal | beam search in the graph | approximate search | recall drops | ann index | embedding space | high dimensions | high-dimensional | dimensionality | nprobe | proximity graph | k-means cells | angle ordering | equally far | lists are visited | compressing to | near items near | binary codes | reranking by exact distance | locality-sensitive hashing | kd-tree | search radius | query vector | distance computation",
        "hints": "vector | distance | neighbour | dimensions | cluster | candidate | index",
        "de": "nächste Nachbarn | Vektorsuche | Vektordatenbank | Ähnlichkeitssuche | Kosinusähnlichkeit | euklidische | Quantisierung | Vektor | Dimensionen",
        "fr": "plus proches voisins | recherche vectorielle | base vectorielle | similarité cosinus | distance euclidienne | quantification | vecteur | grande dimension",
        "es": "vecinos más cercanos | búsqueda vectorial | base vectorial | similitud del coseno | distancia euclidiana | cuantización | alta dimensión",
        "project": "subspace | probe count | rescore pass | inverted list | beam width | distance kernel | residual | cluster split | quantizer | neighbour list | unit vector | pruning rule | entry point | candidate pool | search list | cosine score | centroid | dense matrix | graph layer | sign-bit code | ordinal map | hub node",
        "project_de": "Einstiegsknoten | Suchbreite | Einheitsvektor | Schwerpunkt | Codebuch | Nachbarliste | Teilraum | Skalarprodukt | Distanzfunktion | Quantisierer | Graphebene | Kandidatenmenge",
        "project_fr": "sous-espace | vecteur unitaire | point d'entrée | la distance | produit scalaire | quantificateur | liste de voisins | réserve de candidats | couche du graphe | largeur de recherche | dictionnaire de codes | centroïde",
        "project_es": "subespacio | lista de vecinos | vector unitario | capa del grafo | libro de códigos | reserva de candidatos | producto escalar | cuantizador | centroide | nodo de entrada | anchura de búsqueda | la distancia",
    },
}
