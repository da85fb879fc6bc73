"""Declared schemas of everything that is read or produced, as DDL."""

PRODUCT = "id string, name string, url string, specs map<string,string>, variants array<struct<color:string,price:string,stock:string>>, description string"
FAQ = "id string, name string, faq map<string,string>"
POLICY = "section_index int, title string, content string"
CHUNK = "chunk_id string, product_id string, text string, metadata struct<product_id:string,product_name:string,product_url:string,section_title:string,sub_title:string,type:string>"
PLAN = "cleaned_query string, need_decomposition boolean, sub_queries array<string>"
GOLDEN = "query string, expected_product_id array<string>, expected_type array<string>"
VERIFICATION = "statement string, supported boolean, reason string"
