"""The source system's table of skill patterns, its bullet stop words and its aliases."""

from __future__ import annotations

#: Patterns by category, without the word edges, which extraction adds. Order matters: the first match of a name stays.
PATTERNS: dict[str, tuple[str, ...]] = {
    "programming_languages": (
        r"Python",
        r"JavaScript",
        r"Java",
        r"C\+\+",
        r"C#",
        r"Go",
        r"Rust",
        r"PHP",
        r"Ruby",
        r"Swift",
        r"Kotlin",
        r"TypeScript",
        r"Scala",
        r"R",
        r"MATLAB",
        r"Julia",
        r"Dart",
        r"Elixir",
        r"Clojure",
        r"Haskell",
    ),
    "frameworks_libraries": (
        r"Spring\s+Boot",
        r"Ruby on Rails",
        r"Tailwind\s+CSS",
        r"Material[-\s]UI",
        r"Ant\s+Design",
        r"Styled\s+Components",
        r"Express\.?js",
        r"Node\.?js",
        r"React\.?js",
        r"Vue\.?js",
        r"Next\.?js",
        r"Nuxt\.?js",
        r"React",
        r"ReactJS",
        r"Angular",
        r"VueJS",
        r"Django",
        r"Flask",
        r"FastAPI",
        r"NodeJS",
        r"Spring",
        r"Laravel",
        r"Symfony",
        r"ASP\.NET",
        r"Bootstrap",
        r"jQuery",
        r"Redux",
        r"MobX",
        r"Vuex",
        r"Gatsby",
    ),
    "databases": (
        r"PostgreSQL",
        r"MySQL",
        r"MongoDB",
        r"Redis",
        r"SQLite",
        r"Oracle",
        r"SQL Server",
        r"MariaDB",
        r"Cassandra",
        r"DynamoDB",
        r"Elasticsearch",
        r"InfluxDB",
        r"Neo4j",
        r"CouchDB",
        r"ArangoDB",
    ),
    "cloud_platforms": (
        r"AWS",
        r"Amazon Web Services",
        r"Azure",
        r"Google Cloud",
        r"GCP",
        r"DigitalOcean",
        r"Heroku",
        r"Vercel",
        r"Netlify",
        r"Firebase",
        r"Cloudflare",
        r"Linode",
        r"Vultr",
        r"IBM Cloud",
        r"Oracle Cloud",
    ),
    "devops_tools": (
        r"Docker",
        r"Kubernetes",
        r"Jenkins",
        r"GitLab CI",
        r"GitHub Actions",
        r"Travis CI",
        r"CircleCI",
        r"Ansible",
        r"Terraform",
        r"Chef",
        r"Puppet",
        r"Vagrant",
        r"Prometheus",
        r"Grafana",
        r"ELK Stack",
        r"Splunk",
        r"Datadog",
        r"New Relic",
    ),
    "version_control": (
        r"Git",
        r"GitHub",
        r"GitLab",
        r"Bitbucket",
        r"SVN",
        r"Mercurial",
    ),
    "data_science": (
        r"Pandas",
        r"NumPy",
        r"Matplotlib",
        r"Seaborn",
        r"Plotly",
        r"Scikit-learn",
        r"TensorFlow",
        r"PyTorch",
        r"Keras",
        r"Jupyter",
        r"Hadoop",
        r"Spark",
        r"Kafka",
        r"Airflow",
        r"Dask",
        r"XGBoost",
        r"LightGBM",
        r"CatBoost",
    ),
    "web_technologies": (
        r"HTML5",
        r"CSS3",
        r"REST",
        r"GraphQL",
        r"WebSocket",
        r"OAuth",
        r"JWT",
        r"OpenAPI",
        r"Swagger",
        r"Webpack",
        r"Vite",
        r"Parcel",
        r"Babel",
        r"ESLint",
        r"Prettier",
        r"Sass",
        r"Less",
        r"Stylus",
    ),
    "dotnet_ecosystem": (
        r"\.NET\s+Core",
        r"\.NET\s+5",
        r"\.NET\s+6",
        r"\.NET\s+7",
        r"\.NET\s+8",
        r"ASP\.NET\s+Core",
        r"ASP\.NET\s+Core\s+MVC",
        r"ASP\.NET\s+Web\s+API",
        r"Entity\s+Framework\s+Core",
        r"Entity\s+Framework",
        r"\.NET\s+MAUI",
        r"Blazor",
        r"SignalR",
        r"Minimal\s+APIs",
        r"C#",
        r"F#",
        r"VB\.NET",
    ),
    "build_test_tools": (
        r"Maven",
        r"Gradle",
        r"Ant",
        r"MSBuild",
        r"NuGet",
        r"JUnit",
        r"JUnit\s+5",
        r"TestNG",
        r"Mockito",
        r"Pytest",
        r"PHPUnit",
        r"Jest",
        r"Mocha",
        r"Chai",
        r"Selenium",
        r"Cypress",
        r"Playwright",
        r"Puppeteer",
        r"SonarQube",
        r"SonarLint",
        r"JaCoCo",
    ),
    "cloud_services": (
        r"AWS\s+Lambda",
        r"AWS\s+EC2",
        r"AWS\s+S3",
        r"AWS\s+RDS",
        r"Azure\s+Functions",
        r"Azure\s+App\s+Service",
        r"Azure\s+DevOps",
        r"Event\s+Grid",
        r"Service\s+Bus",
        r"Logic\s+Apps",
        r"Google\s+Cloud\s+Functions",
        r"Google\s+Cloud\s+Run",
        r"Cosmos\s+DB",
        r"DynamoDB",
        r"Firestore",
    ),
    "compound_skills": (
        r"CI/CD",
        r"CI\s*/\s*CD",
        r"REST\s+API",
        r"REST\s+APIs",
        r"RESTful\s+API",
        r"GraphQL\s+API",
        r"Event-Driven\s+Architecture",
        r"Event\s+Driven",
        r"Service-Oriented\s+Architecture",
        r"SOA",
        r"Object-Oriented\s+Programming",
        r"OOP",
        r"Programación\s+orientada\s+a\s+objetos",
        r"POO",
        r"Test-Driven\s+Development",
        r"TDD",
        r"Behavior-Driven\s+Development",
        r"BDD",
        r"Domain-Driven\s+Design",
        r"DDD",
    ),
    "bi_data_tools": (
        r"Power\s+BI",
        r"Power\s+BI\s+Desktop",
        r"Power\s+BI\s+Service",
        r"Tableau",
        r"Qlik",
        r"Looker",
        r"Metabase",
        r"Databricks",
        r"Snowflake",
        r"Redshift",
        r"Data\s+Lake",
        r"Data\s+Warehouse",
        r"Data\s+Pipeline",
        r"DAX",
        r"Power\s+Query",
        r"M\s+language",
        r"CTE",
        r"OLS",
        r"RLS",
        r"Parquet",
        r"Delta",
    ),
    "ner_migrated_skills": (
        r"API\s+Gateway",
        r"IAM",
        r"Web\s+Services",
        r"SOAP",
        r"SOAPUI",
        r"JSON",
        r"SSR",
        r"SCSS",
        r"SEO",
        r"CSRF",
        r"Ably",
        r"Mapbox",
        r"Twilio",
        r"Stripe",
        r"Sentry",
        r"Quarkus",
        r"Logback",
        r"Scrum",
        r"Excel",
    ),
    "exact_missing_skills": (
        r"IBMMQ",
        r"RabbitMQ",
        r"Rabbit\s+MQ",
        r"Java\s+\d+\+?",
        r"JPA",
        r"SLF4J",
        r"Sybase",
        r"OAuth2",
        r"OAuth\s+2",
        r"Autenticación",
        r"Seguridad",
        r"Visual\s+Studio\s+Code",
        r"IntelliJ\s+IDEA",
        r"Eclipse",
        r"NgRx",
        r"RxJS",
        r"GCP",
        r"Google\s+Cloud\s+Platform",
        r"HTML5",
        r"HTML\s+5",
        r"Arquitectura\s+SOA",
        r"Bases?\s+de\s+datos\s+relacionales",
        r"Bases?\s+de\s+datos\s+no\s+relacionales",
        r"Dataflows?\s+Gen2",
        r"DAX\s+Studio",
        r"Lakehouse",
        r"Microsoft\s+Fabric",
        r"OneLake",
        r"Particionado",
        r"Procedimientos?\s+almacenados?",
        r"Modelado\s+de\s+datos",
        r"Control\s+de\s+versiones",
        r"Incremental\s+Refresh",
        r"Infrastructure\s+as\s+Code",
        r"Observabilidad",
    ),
    "onet_esco_technical_skills": (
        r"AJAX",
        r"API Design",
        r"API Security",
        r"ASP\.NET Core",
        r"AWS Lambda",
        r"Adobe Acrobat",
        r"Adobe After Effects",
        r"Adobe Illustrator",
        r"Adobe InDesign",
        r"Adobe Photoshop",
        r"Agile",
        r"Alteryx software",
        r"Amazon DynamoDB",
        r"Amazon Elastic Compute Cloud EC2",
        r"Amazon Redshift",
        r"Amazon Simple Storage Service S3",
        r"Amazon Web Services AWS CloudFormation",
        r"Ansible software",
        r"Apache Airflow",
        r"Apache Cassandra",
        r"Apache Hadoop",
        r"Apache Hive",
        r"Apache Kafka",
        r"Apache Maven",
        r"Apache Pulsar",
        r"Apache Spark",
        r"Apache Subversion SVN",
        r"Apache Tomcat",
        r"Apple Safari",
        r"Apple iOS",
        r"Apple macOS",
        r"Atlassian Bitbucket",
        r"Atlassian Confluence",
        r"Atlassian JIRA",
        r"Auth0",
        r"Authentication",
        r"Authorization",
        r"Autodesk AutoCAD",
        r"Autodesk Revit",
        r"Backend Development",
        r"Bash",
        r"Behavior-Driven Development",
        r"Bentley MicroStation",
        r"BigQuery",
        r"Bootstrap",
        r"Border Gateway Protocol BGP",
        r"C",
        r"C#",
        r"C\+\+",
        r"Cascading style sheets CSS",
        r"Chef",
        r"CircleCI",
        r"Cisco Webex",
        r"Clerk",
        r"Cloud Native",
        r"Cloudflare",
        r"Code Review",
        r"Computer Vision",
        r"Container Orchestration",
        r"Containerization",
        r"Contentful",
        r"Continuous Deployment",
        r"Continuous Integration",
        r"Cypress",
        r"Dart",
        r"Data Infrastructure",
        r"Data Lake",
        r"Data Pipeline",
        r"Data Warehouse",
        r"Datadog",
        r"Deep Learning",
        r"Django",
        r"Docker",
        r"Domain-Driven Design",
        r"Drupal",
        r"ETL",
        r"Eclipse IDE",
        r"Eclipse Jersey",
        r"Elasticsearch",
        r"Entity Framework",
        r"Epic Systems",
        r"Event-Driven Architecture",
        r"Expo",
        r"Express\.js",
        r"Extensible markup language XML",
        r"Facebook",
        r"FastAPI",
        r"Figma",
        r"Firebase",
        r"Flask",
        r"Flutter",
        r"Frontend Development",
        r"Full-Stack Development",
        r"Git",
        r"GitHub",
        r"GitHub Actions",
        r"GitLab",
        r"GitLab CI\/CD",
        r"Go",
        r"Google Analytics",
        r"Google Android",
        r"Google Angular",
        r"Google Cloud Platform",
        r"Google Docs",
        r"Google Sheets",
        r"Grafana",
        r"GraphQL",
        r"GraphQL API",
        r"Helm",
        r"Heroku",
        r"Hibernate ORM",
        r"HubSpot software",
        r"Hugging Face",
        r"Hypertext markup language HTML",
        r"IBM DB2",
        r"IBM SPSS Statistics",
        r"IBM Terraform",
        r"IBM WebSphere MQ",
        r"Informatica software",
        r"Infrastructure as Code",
        r"Ionic",
        r"JUnit",
        r"JWT",
        r"JavaScript",
        r"JavaScript Object Notation JSON",
        r"Jenkins CI",
        r"Jest",
        r"Jupyter Notebook",
        r"Keras",
        r"Keycloak",
        r"Kotlin",
        r"Kubernetes",
        r"LangChain",
        r"Laravel",
        r"Linux",
        r"MEDITECH software",
        r"MLOps",
        r"Machine Learning",
        r"Magento",
        r"Marketo Marketing Automation",
        r"Material-UI",
        r"Microservices",
        r"Microsoft \.NET Framework",
        r"Microsoft ASP\.NET",
        r"Microsoft Access",
        r"Microsoft Active Directory",
        r"Microsoft Active Server Pages ASP",
        r"Microsoft Azure",
        r"Microsoft Dynamics",
        r"Microsoft Excel",
        r"Microsoft Outlook",
        r"Microsoft Power BI",
        r"Microsoft PowerPoint",
        r"Microsoft PowerShell",
        r"Microsoft Project",
        r"Microsoft SQL Server",
        r"Microsoft SQL Server Integration Services SSIS",
        r"Microsoft SQL Server Reporting Services SSRS",
        r"Microsoft SharePoint",
        r"Microsoft Team Foundation Server",
        r"Microsoft Teams",
        r"Microsoft Visio",
        r"Microsoft Visual Basic",
        r"Microsoft Visual Studio",
        r"Microsoft Windows",
        r"Microsoft Windows Server",
        r"Microsoft Word",
        r"MongoDB",
        r"Mozilla Firefox",
        r"MySQL",
        r"NATS",
        r"Natural Language Processing",
        r"NestJS",
        r"Netlify",
        r"New Relic",
        r"Next\.js",
        r"Nginx",
        r"NoSQL",
        r"Node\.js",
        r"NumPy",
        r"Nuxt\.js",
        r"OAuth 2\.0",
        r"OWASP",
        r"Oracle Database",
        r"Oracle Java",
        r"Oracle Java 2 Platform Enterprise Edition J2EE",
        r"Oracle PL\/SQL",
        r"Oracle PeopleSoft",
        r"Oracle Primavera Enterprise Project Portfolio Management",
        r"Oracle SQL Developer",
        r"PHP",
        r"Pair Programming",
        r"Pandas",
        r"Perl",
        r"Playwright",
        r"PostgreSQL",
        r"Postman",
        r"Prisma",
        r"Progressive Web Apps",
        r"Prometheus",
        r"Puppet",
        r"PyTorch",
        r"Pytest",
        r"Python",
        r"R",
        r"REST API",
        r"RESTful API",
        r"RabbitMQ",
        r"React",
        r"React Native",
        r"React Testing Library",
        r"Red Hat Enterprise Linux",
        r"Red Hat OpenShift",
        r"Redis",
        r"Redux",
        r"Reinforcement Learning",
        r"Remix",
        r"Responsive Design",
        r"Ruby",
        r"Ruby on Rails",
        r"Rust",
        r"SAP ERP",
        r"SAP software",
        r"SAS",
        r"Salesforce software",
        r"Sanity",
        r"Scala",
        r"Scikit-learn",
        r"Scrum",
        r"Selenium",
        r"Sentry",
        r"Sequelize",
        r"Serverless",
        r"ServiceNow",
        r"Shadcn\/ui",
        r"Shell script",
        r"Shopify",
        r"Single Page Application",
        r"Slack",
        r"Snowflake",
        r"Splunk Enterprise",
        r"Spring Boot",
        r"Spring Framework",
        r"Strapi",
        r"Stream Processing",
        r"Stripe",
        r"Structured query language SQL",
        r"Supabase",
        r"Svelte",
        r"Swift",
        r"Tableau",
        r"Tailwind CSS",
        r"TensorFlow",
        r"Teradata Database",
        r"Test-Driven Development",
        r"The MathWorks MATLAB",
        r"Transact-SQL",
        r"Trimble SketchUp Pro",
        r"TypeScript",
        r"UNIX",
        r"UNIX Shell",
        r"Vercel",
        r"Vite",
        r"Vitest",
        r"Vue\.js",
        r"Web Security",
        r"Webpack",
        r"WooCommerce",
        r"WordPress",
        r"Workday software",
        r"Yardi software",
        r"Zoom",
        r"Zustand",
        r"dbt",
        r"jQuery",
        r"tRPC",
    ),
    "contextualized_spanish": (
        r"(?:experiencia|conocimiento|manejo|dominio|expertise)\s+(?:en|de|con)\s+(Python|Java|JavaScript|TypeScript|Go|Rust|PHP|Ruby|Swift|Kotlin|C\+\+|C#)",
        r"(?:experiencia|conocimiento|manejo|dominio)\s+(?:en|de|con)\s+(?:bases?\s+de\s+datos\s+)?(PostgreSQL|MySQL|MongoDB|Redis|Oracle|SQL\s+Server|Cassandra|Elasticsearch)",
        r"(?:experiencia|conocimiento|dominio)\s+(?:en|de|con)\s+(React|Angular|Vue\.?js|Django|Flask|FastAPI|Spring|Laravel|Node\.?js|Express\.?js)",
        r"(?:experiencia|conocimiento)\s+(?:en|de|con)\s+(AWS|Azure|Google\s+Cloud|GCP|Firebase)",
        r"(?:experiencia|conocimiento|manejo)\s+(?:en|de|con)\s+(Docker|Kubernetes|Jenkins|Terraform|Ansible)",
        r"(?:desarrollo|programación|desarrollo de software|desarrollo web)\s+(?:en|con)\s+(Python|Java|JavaScript|TypeScript|React|Angular|Vue|Django|Flask|Node\.?js)",
        r"(Python|Java|JavaScript|SQL|PostgreSQL|MySQL|MongoDB|React|Angular|Vue|Docker|Kubernetes|AWS|Azure)\s+(?:avanzado|intermedio|básico|nivel\s+avanzado|nivel\s+intermedio)",
        r"(?:diseño|arquitectura|implementación|integración)\s+(?:de|con)\s+(microservicios|APIs?|REST|GraphQL|sistemas\s+distribuidos)",
        r"(?:administración|gestión|configuración)\s+de\s+(bases?\s+de\s+datos|servidores|infraestructura|sistemas|redes)",
    ),
    "bullet_point_skills": (
        r"[·•\-]\s*([A-Za-z][A-Za-z0-9\s\.+#\-/]+?)(?=\s*[·•\-]|\s*$|\s*\n)",
        r":\s*([A-Za-z][A-Za-z0-9\s\.+#]+?)(?=\s*,|\s*$|\s*\n)",
    ),
}

#: A bullet that holds one of these words is no skill.
BULLET_STOPWORDS = frozenset(
    ("to", "in", "of", "as", "by", "on", "at", "or", "an", "is", "it", "end", "c", "r", "d", "e", "s", "a", "b", "p", "m", "n", "o", "q", "u", "v", "w", "x", "y", "z", "piano", "cat", "true", "false", "type", "search", "window", "data", "var", "const", "let", "function", "document")
)

#: Alias and canonical name by dictionary; later dictionaries win.
ALIAS_TABLES: dict[str, dict[str, str]] = {
    "lang": {
        "py": "Python",
        "python": "Python",
        "js": "JavaScript",
        "javascript": "JavaScript",
        "ts": "TypeScript",
        "typescript": "TypeScript",
        "golang": "Go",
        "go": "Go",
        "java": "Java",
        "ruby": "Ruby",
        "php": "PHP",
        "swift": "Swift",
        "kotlin": "Kotlin",
        "rust": "Rust",
    },
    "db": {
        "postgres": "PostgreSQL",
        "postgresql": "PostgreSQL",
        "psql": "PostgreSQL",
        "mysql": "MySQL",
        "mongo": "MongoDB",
        "mongodb": "MongoDB",
        "redis": "Redis",
        "elasticsearch": "Elasticsearch",
        "cassandra": "Cassandra",
    },
    "framework": {
        "react": "React",
        "reactjs": "React",
        "react.js": "React",
        "react native": "React Native",
        "angular": "Angular",
        "angularjs": "Angular",
        "angular.js": "Angular",
        "vue": "Vue.js",
        "vuejs": "Vue.js",
        "vue.js": "Vue.js",
        "django": "Django",
        "flask": "Flask",
        "fastapi": "FastAPI",
        "spring": "Spring",
        "laravel": "Laravel",
        "rails": "Ruby on Rails",
        "ruby on rails": "Ruby on Rails",
    },
    "cloud": {
        "aws": "AWS",
        "amazon web services": "AWS",
        "azure": "Microsoft Azure",
        "microsoft azure": "Microsoft Azure",
        "gcp": "Google Cloud Platform",
        "google cloud": "Google Cloud Platform",
    },
    "devops": {
        "docker": "Docker",
        "k8s": "Kubernetes",
        "kubernetes": "Kubernetes",
        "jenkins": "Jenkins",
        "gitlab": "GitLab",
        "terraform": "Terraform",
        "ansible": "Ansible",
    },
    "ml": {
        "tensorflow": "TensorFlow",
        "pytorch": "PyTorch",
        "pandas": "Pandas",
        "numpy": "NumPy",
        "jupyter": "Jupyter",
        "keras": "Keras",
    },
    "vcs": {
        "git": "Git",
        "github": "GitHub",
        "gitlab": "GitLab",
    },
    "web": {
        "html": "HTML",
        "html5": "HTML",
        "css": "CSS",
        "css3": "CSS",
        "rest": "REST",
        "restful": "REST",
        "graphql": "GraphQL",
        "soap": "SOAP",
    },
    "enterprise": {
        "sap": "SAP",
        "salesforce": "Salesforce",
        "sap erp": "SAP ERP",
        "peoplesoft": "PeopleSoft",
        "servicenow": "ServiceNow",
        "jira": "Jira",
        "confluence": "Confluence",
    },
    "microsoft": {
        "excel": "Excel",
        "power bi": "Power BI",
        "powerbi": "Power BI",
        "sharepoint": "SharePoint",
        "office 365": "Office 365",
    },
    "testing_mobile": {
        "selenium": "Selenium",
        "jest": "Jest",
        "pytest": "Pytest",
        "android": "Android",
        "ios": "iOS",
        "flutter": "Flutter",
    },
    "domain_specific": {
        ".net core": ".NET Core",
        "asp.net core": "ASP.NET Core",
        "entity framework": "Entity Framework",
        "entity framework core": "Entity Framework Core",
        "c#": "C#",
        "csharp": "C#",
        "maven": "Maven",
        "gradle": "Gradle",
        "junit": "JUnit",
        "sonarqube": "SonarQube",
        "ci/cd": "CI/CD",
        "rest api": "REST API",
        "oop": "OOP",
        "poo": "POO",
        "tdd": "TDD",
        "bdd": "BDD",
        "ddd": "DDD",
        "soa": "SOA",
        "arquitectura soa": "Arquitectura SOA",
        "power bi": "Power BI",
        "databricks": "Databricks",
        "data lake": "Data Lake",
        "dax": "DAX",
        "dax studio": "DAX Studio",
        "lakehouse": "Lakehouse",
        "onelake": "OneLake",
        "parquet": "Parquet",
        "delta": "Delta",
        "cte": "CTE",
        "ols": "OLS",
        "rls": "RLS",
        "api gateway": "API Gateway",
        "iam": "IAM",
        "web services": "Web Services",
        "soap": "SOAP",
        "soapui": "SOAPUI",
        "json": "JSON",
        "ssr": "SSR",
        "scss": "SCSS",
        "seo": "SEO",
        "csrf": "CSRF",
        "ably": "Ably",
        "mapbox": "Mapbox",
        "twilio": "Twilio",
        "stripe": "Stripe",
        "sentry": "Sentry",
        "quarkus": "Quarkus",
        "logback": "Logback",
        "scrum": "Scrum",
        "ibmmq": "IBMMQ",
        "rabbitmq": "RabbitMQ",
        "jpa": "JPA",
        "slf4j": "SLF4J",
        "sybase": "Sybase",
        "oauth2": "OAuth2",
        "oauth 2": "OAuth2",
        "autenticación": "Autenticación",
        "seguridad": "Seguridad",
        "visual studio code": "Visual Studio Code",
        "intellij idea": "IntelliJ IDEA",
        "eclipse": "Eclipse",
        "ngrx": "NgRx",
        "rxjs": "RxJS",
        "gcp": "GCP",
        "html5": "HTML5",
        "modelado de datos": "Modelado de datos",
        "observabilidad": "Observabilidad",
    },
}
ALIASES = {alias: name for names in ALIAS_TABLES.values() for alias, name in names.items()}
